"""Training-data operators: one module for each, with the thin registered queries in queries.py."""
