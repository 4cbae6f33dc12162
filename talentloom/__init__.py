"""Spark-first document-to-decision analytics engine."""
