"""Spark-native analytics over model-evaluation tables."""
