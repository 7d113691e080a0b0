"""Spark-native corpus retrieval, retrieval evaluation and corpus preparation."""
