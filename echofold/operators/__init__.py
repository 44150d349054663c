"""Operators on streams, candidates and matches; each takes and returns DataFrames."""
