"""Operators of a review: each takes tables and returns a table."""
