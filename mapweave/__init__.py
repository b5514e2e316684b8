"""Incremental visual-map analytics as Spark jobs."""
