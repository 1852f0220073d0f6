"""marlstone: exact, explainable filtering of columnar files on Spark."""
