"""Anti-joins and reconciliation of data files with a table."""
