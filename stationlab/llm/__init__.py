"""Operators for training-data pipelines over documents, their labels, pages and embeddings."""
