"""Queries over the given tables: pairs, Spark side and SQL side."""
