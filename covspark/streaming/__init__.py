"""Structured Streaming forms of ingest, coverage, event log and activity."""
