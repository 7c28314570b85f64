"""Structured Streaming: counts over event time, and change events of watched roots."""
