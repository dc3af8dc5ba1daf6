"""Spark-native analytics over semi-structured web captures."""
