"""Structured Streaming forms of the live operators."""
