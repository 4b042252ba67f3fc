"""Spark-native mobility analytics."""
