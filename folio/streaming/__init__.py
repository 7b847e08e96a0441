"""Structured Streaming: page ingest and progress."""
