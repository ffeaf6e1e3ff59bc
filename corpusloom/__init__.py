"""Spark-first analytics for text-retrieval data."""
