"""Operators for large training-data corpora, as Spark jobs over (doc_id, text, ...) tables."""
