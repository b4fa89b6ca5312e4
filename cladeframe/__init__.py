"""Spark-native analytics over single-cell mutation observations."""
