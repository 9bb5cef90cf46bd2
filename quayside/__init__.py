"""Spark-native analytics over logs of price and availability changes."""

__version__ = "0.1.0"
