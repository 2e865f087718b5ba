"""Structured Streaming forms of the decision path (survey 2.13)."""
