"""Spark-native analytics for building and scoring document-based evaluation data."""
