"""Queries: each names an operator over the tables of a folder and the SQL that says what it must return."""
