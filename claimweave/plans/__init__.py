"""Composed plans: the end-to-end build and the named queries."""
