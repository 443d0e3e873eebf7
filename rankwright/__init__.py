"""Spark-native retrieval evaluation and data-processing engine."""
