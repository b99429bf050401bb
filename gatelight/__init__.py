"""Spark-native validation, sequence analysis and corpus preparation over plain tables."""
