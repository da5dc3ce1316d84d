"""Prismora: a Spark-first engine for measuring and developing camera sensor images."""

__version__ = "0.1.0"
