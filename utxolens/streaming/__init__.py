"""Structured Streaming: incremental block-file ingest."""
