"""Whole queries over the input tables."""
