"""Queries: the operators applied to tables, each with the same result as SQL."""
