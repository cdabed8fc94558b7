"""Spark-native feature, scoring and evaluation jobs for click-through data."""
