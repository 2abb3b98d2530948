"""Registered queries: modules with QUERIES and SQL dictionaries."""
