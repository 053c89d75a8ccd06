"""Spark-native analytics for turning documents into structured, categorised records."""

__version__ = "0.1.0"
