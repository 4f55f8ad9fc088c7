"""Structured Streaming forms of the modes."""
