"""Tidemark: a PySpark-native engine for tick, bar and research analytics."""
