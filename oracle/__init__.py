"""Equivalent SQL of the named queries, for checking them with another engine."""
