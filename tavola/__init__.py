"""Spark-native venue and menu analytics."""
