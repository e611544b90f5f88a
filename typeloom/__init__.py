"""Spark-native semantic typing and profiling of tables."""
