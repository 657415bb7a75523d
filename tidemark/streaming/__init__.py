"""Structured Streaming forms of discovery, change detection, staleness and indexing."""
