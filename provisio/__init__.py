"""Spark-native analytics over hierarchical legal and contract text."""

__version__ = "0.1.0"
