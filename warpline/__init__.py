"""Spark-native threat-infrastructure correlation engine."""
