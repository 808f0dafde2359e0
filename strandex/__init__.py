"""Spark-native full-text sequence index."""
