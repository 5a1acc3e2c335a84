"""The catalog's jobs, each a function from tables to tables."""
