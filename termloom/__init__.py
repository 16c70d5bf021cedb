"""Coursework analytics over many students, expressed as Spark DataFrame operations."""

__version__ = "0.1.0"
