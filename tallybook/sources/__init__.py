"""Readers, ingest and effective history."""
