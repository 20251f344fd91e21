"""Spark-native multi-feature similarity search and corpus processing."""

__version__ = "0.1.0"
