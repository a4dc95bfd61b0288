"""Spark-native measurement of what a crowd is talking about."""

__version__ = "0.1.0"
