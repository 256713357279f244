"""Spark-native typed page extraction and query engine."""
