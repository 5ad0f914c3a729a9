"""Structured Streaming variants: archives as they arrive, and running ledgers."""
