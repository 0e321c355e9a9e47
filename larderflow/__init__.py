"""Spark-native extraction of structured recipe records from pages, text and images."""

__version__ = "0.1.0"
