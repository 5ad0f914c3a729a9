"""Relational operators of the engine over DataFrames."""
