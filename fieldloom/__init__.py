"""Spark-native document-field and document-analytics engine."""
