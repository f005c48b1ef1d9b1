"""Operators for training-data pipelines over the documents, pages and embeddings tables."""
