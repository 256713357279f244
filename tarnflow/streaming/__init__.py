"""Continuous refresh with Structured Streaming."""
