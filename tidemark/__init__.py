"""Tidemark: corpus, retrieval and evaluation analytics on Spark."""
