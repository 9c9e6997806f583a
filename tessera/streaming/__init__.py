"""Incremental forms by Structured Streaming."""
