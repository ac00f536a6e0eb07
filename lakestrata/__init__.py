"""Layered (bronze, silver, gold) batch pipelines as plain Spark DataFrame jobs."""
