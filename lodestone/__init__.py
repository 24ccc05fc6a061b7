"""Lodestone: a PySpark-native engine for search candidate generation and its analytics."""
