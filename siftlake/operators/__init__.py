"""Operators over chunks, candidates and findings; each takes and returns DataFrames."""
