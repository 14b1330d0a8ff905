"""Structured Streaming scoring against a stored model table."""
