"""A Spark-native library for rule-based analysis of Turkish text."""
