"""Spark-native engine: sprite timelines, and operators for training data."""
