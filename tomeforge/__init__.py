"""tomeforge: a Spark-native engine for searching and analysing document collections."""

__version__ = "0.1.0"
