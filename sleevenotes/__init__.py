"""Catalog quality analytics as Spark DataFrame jobs."""
