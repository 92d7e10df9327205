"""Structured Streaming jobs over the append-only facts."""
