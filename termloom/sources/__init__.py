"""Readers of captured documents, and the tables."""
