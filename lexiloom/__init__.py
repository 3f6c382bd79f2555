"""Spark-native analytics over document collections: text, features, topics, languages."""
