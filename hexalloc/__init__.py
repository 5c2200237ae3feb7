"""Spark-native prioritisation and allocation analytics."""
