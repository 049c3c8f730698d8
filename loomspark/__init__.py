"""Spark-native analytics over versioned source trees, their history and the text around them."""

__version__ = "0.1.0"
