"""Spark-native analytics engine for scholarly text and argument-structure data."""

__version__ = "0.1.0"
