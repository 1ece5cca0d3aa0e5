"""Spark-native extraction of structured facts from documents."""

__version__ = "0.1.0"
