"""Relational operators over corpus, queries, qrels, runs and embeddings."""
