"""Operators of the page-risk engine."""
