"""Structured Streaming extensions (not part of the batch report engine)."""
