"""Spark-native anomaly analytics over canonical event tables."""
