"""Spark-native product and text matching engine."""
