"""Fixture views and the query registry."""
