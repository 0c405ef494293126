"""Siltstone: documentation indexing and hybrid search as Spark plans."""

__version__ = "0.1.0"
