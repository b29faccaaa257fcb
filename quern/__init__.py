"""A PySpark-native engine for storing, indexing and ranking schema-less documents."""

__version__ = "0.1.0"
