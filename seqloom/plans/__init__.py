"""Queries of the operators over the given tables, each beside SQL that states the same rows."""
