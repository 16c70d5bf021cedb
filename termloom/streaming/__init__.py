"""Structured Streaming entry points: continuous snapshot synchronisation and the audit log."""
