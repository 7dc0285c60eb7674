"""Column builders; no Python runs per row in this package."""
