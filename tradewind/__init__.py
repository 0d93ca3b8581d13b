"""Spark-native conversational-commerce analytics."""
