"""Structured Streaming: incremental ingest of batch outputs."""
