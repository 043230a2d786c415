"""Civic-record analytics on Spark: interval operators, read models, quality checks and text processing."""
