"""Spark-native log sanitization and anomaly analytics."""
