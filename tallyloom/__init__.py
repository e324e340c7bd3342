"""Spark-native order capture, recognition and reporting engine."""
