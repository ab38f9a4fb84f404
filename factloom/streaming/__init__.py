"""Structured Streaming: windows over event time, and the incremental ingest of pages."""
