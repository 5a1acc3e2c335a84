"""Operators for preparing training text at scale, and the queries that bind them to the given tables."""
