"""tablework: a Spark-native analytics toolkit for tabular data."""

__version__ = "0.1.0"
