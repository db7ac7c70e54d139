"""Keyed operations over unbounded sources, with Structured Streaming."""
