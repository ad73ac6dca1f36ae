"""Spark-native analytics over tables, texts and concept graphs."""
