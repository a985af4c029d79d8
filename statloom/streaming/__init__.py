"""Structured Streaming forms of the counter, event and retention operators."""
