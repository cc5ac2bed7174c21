"""Streaming of the page-risk engine."""
