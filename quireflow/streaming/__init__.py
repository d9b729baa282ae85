"""Continuous forms of the batch operators, on Structured Streaming."""
