"""Spark-native scoring analytics on large labelled tables."""
