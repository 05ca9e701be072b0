"""Registered queries: every relational operator applied to the given tables, beside the same in SQL."""
