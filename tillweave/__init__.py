"""Spark-native ledger analytics engine."""

__version__ = "0.1.0"
