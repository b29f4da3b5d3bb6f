"""Catalogue search, duplicate detection and index upkeep as Spark jobs."""
