"""Spark-native data processing around document recognition."""
