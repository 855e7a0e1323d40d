"""Incremental ingestion of verdicts with Structured Streaming."""
