"""Structured Streaming forms of the scoring path."""
