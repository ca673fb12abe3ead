"""Structured Streaming jobs over annotation events."""
