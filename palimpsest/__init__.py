"""Versioned key-value data on PySpark: every read is a query over a history."""

__version__ = "0.1.0"
