"""Readers and writers: revisions, provider envelopes, logs, exports."""
