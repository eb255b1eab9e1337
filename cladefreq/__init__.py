"""Prevalence analytics over lineage-grouped entities, as Spark DataFrame jobs."""

__version__ = "0.1.0"
