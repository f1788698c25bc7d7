"""Spark-native duplicate and similarity analytics over large collections."""

__version__ = "0.1.0"
