"""Readers: each gives a DataFrame of chunks (text with its origin), and rows for what it could not cover."""
