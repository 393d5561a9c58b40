"""Event, registry and request tables."""
