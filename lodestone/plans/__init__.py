"""Queries over the shared tables, each with SQL that must return the same rows."""
