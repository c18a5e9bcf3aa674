"""Structured Streaming versions of the online path."""
