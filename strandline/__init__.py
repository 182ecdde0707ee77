"""Spark-native genome annotation analytics."""

__version__ = "0.1.0"
