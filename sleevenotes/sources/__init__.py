"""Catalog views over the given tables, and readers and writers."""
