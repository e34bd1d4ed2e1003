"""Spark-native hybrid retrieval, evidence assembly and corpus operators."""
