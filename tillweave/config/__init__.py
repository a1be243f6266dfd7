"""Declared configuration: profiles of sources and rules, read and validated on the driver."""
