"""Spark-native analytics over statistical knowledge graphs."""
