"""Queries over the driver tables, each with the DuckDB statement it must agree with."""
