"""Site-audit engine: plans."""
