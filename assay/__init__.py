"""Spark-native analytics over software-test quality data."""
