"""Spark-native byte-sequence and archive analytics."""
