"""Queries: predicate, produced columns, output, window; and their text front end and explain."""
