"""Site-audit engine: functions."""
