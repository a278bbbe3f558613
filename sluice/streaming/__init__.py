"""Incremental ingestion and stateful merges on Structured Streaming."""
