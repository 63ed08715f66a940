"""Queries over the standard tables, and the SQL that gives the same rows."""
