"""Catalogue, pricing, search and recipe analytics as PySpark DataFrame jobs."""
