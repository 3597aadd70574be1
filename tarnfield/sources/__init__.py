"""Readers for the input tables."""

from tarnfield.sources.tables import TABLES, read_table

__all__ = ["TABLES", "read_table"]
