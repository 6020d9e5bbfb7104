"""Quarry: a PySpark-native engine for source code, text and relational facts."""

__version__ = "0.1.0"
