"""Structured Streaming forms of operators that keep bounded state."""
