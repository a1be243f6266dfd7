"""Operators for preparing training corpora and for fuzzy record work.

Nothing outside this package imports it; `__spark_entry__` adds its queries when it is present.
"""
