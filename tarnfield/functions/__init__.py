"""Column helpers built from Spark's own functions."""

from tarnfield.functions.money import exact_sum, hundredths, product

__all__ = ["exact_sum", "hundredths", "product"]
