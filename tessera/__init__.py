"""Spark-native retrieval, grounded answering and training-data engine."""
