"""Queries by area; each module has QUERIES and SQL under the same names."""
