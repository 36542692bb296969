"""millrace: a Spark-native engine that keeps lakehouse tables healthy."""

__version__ = "0.1.0"
