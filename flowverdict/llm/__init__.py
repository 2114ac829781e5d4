"""Operators for training-data corpora, each with the query that applies it."""
