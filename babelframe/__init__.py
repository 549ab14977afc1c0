"""Spark-native preparation, querying and evaluation of multilingual retrieval collections."""
