"""Spark-native analytics over large media libraries and their texts."""
