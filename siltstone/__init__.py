"""Spark-native analytics over source text, version history and message logs."""

__version__ = "0.1.0"
