"""Structured Streaming: continuous ingest and windowed statistics."""
