"""Tarnfield: analytics jobs written with the PySpark DataFrame API."""
