"""Spark-native stream and batch analytics."""
