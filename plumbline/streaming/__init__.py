"""Structured Streaming forms of the scheduling operators."""
