"""Spark engine for corpora of positioned text blocks."""

__version__ = "0.1.0"
