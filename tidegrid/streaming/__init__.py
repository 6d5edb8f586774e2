"""Structured Streaming twins of the series operators."""
