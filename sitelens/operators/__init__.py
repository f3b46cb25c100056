"""Site-audit engine: operators."""
