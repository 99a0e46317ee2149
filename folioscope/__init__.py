"""Spark-native evaluation of page-level text extraction."""
