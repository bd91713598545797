"""Structured Streaming forms of the time-course operators."""
