"""Sinks of audit results."""
