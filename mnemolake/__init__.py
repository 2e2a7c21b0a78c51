"""Spark-native memory analytics engine."""
