"""Structured Streaming: ingest, fights, suggestions, cooldown, running counts."""
