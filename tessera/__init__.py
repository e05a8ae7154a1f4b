"""tessera: a Spark-native engine for semantic storage, retrieval and memory analytics."""

__version__ = "0.1.0"
