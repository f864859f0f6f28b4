"""Relational operators: each takes and returns DataFrames."""
