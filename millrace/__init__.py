"""Warehouse and lineage analytics as Spark DataFrame jobs."""
