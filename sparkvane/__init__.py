"""A PySpark-native vector search and corpus processing engine."""
