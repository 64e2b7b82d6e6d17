"""Spark-first analytics library: typed sources, keyed upserts, marts,
data-quality checks, desired-versus-live plans and lineage graphs."""

__version__ = "0.1.0"
