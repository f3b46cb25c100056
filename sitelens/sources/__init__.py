"""Site-audit engine: sources."""
