"""Detector catalogues, and the registered queries with their SQL."""
