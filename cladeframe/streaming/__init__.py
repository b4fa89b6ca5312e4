"""Structured Streaming forms of the decomposable operators."""
