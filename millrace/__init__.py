"""Spark-native event-log analytics."""
