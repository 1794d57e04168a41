"""Queries that bind operators to tables, and the facade."""
