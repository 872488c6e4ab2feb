"""Spark-native engine for privacy-aware analytics over text, pages and tables."""
