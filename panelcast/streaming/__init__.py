"""Structured Streaming: incremental panel updates from landed files."""
