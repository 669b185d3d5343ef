"""Spark-native analytics over time intervals found in long recordings."""
