"""Spark-native engine for revisioned text records."""
