"""Exact sums of amounts that are stored as ``double``.

A sum of doubles depends on the order of addition, so on a cluster it changes
from run to run. The helpers here keep the per-row work in ``bigint`` and raise,
with ANSI mode on or off, where a result would not be exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 1_000_000
#: Doubles hold every whole number up to here.
_WHOLE = 2.0**53


def hundredths(amount: Column) -> Column:
    """A double with at most two decimals as a whole number of hundredths.

    Null stays null. A value with a further decimal, NaN, an infinity and a value
    of more than 2^53 hundredths raise an error that names it.
    """
    units = F.rint(amount * 100)
    # NaN is greater than any number here, so the first condition refuses it too
    fits = (F.abs(units) <= _WHOLE) & (units / 100 == amount)
    refused = F.raise_error(F.concat(F.lit("no amount in whole hundredths: "), amount.cast("string")))
    return F.when(amount.isNull(), F.lit(None).cast("bigint")).when(fits, units.cast("bigint")).otherwise(refused.cast("bigint"))


def product(a: Column, b: Column) -> Column:
    """Product of two ``bigint`` columns; raises where it passes the range of ``bigint``."""
    made = F.try_multiply(a, b)
    over = F.raise_error(F.concat(F.lit("product beyond bigint: "), a.cast("string"), F.lit(" * "), b.cast("string")))
    return F.when(made.isNotNull() | a.isNull() | b.isNull(), made).otherwise(over.cast("bigint"))


def exact_sum(units: Column) -> Column:
    """Sum a ``bigint`` column into a ``decimal(38,0)``, past the range of ``bigint``.

    Each value is split by a million twice, and the three parts are summed apart.
    The low and middle part stay in range for nine trillion rows of a group, the
    high one, at most 9,223,373 a row, for a trillion rows of any values. A part
    that passes ``bigint`` all the same raises. A group without values is null.
    """
    split = F.lit(_SPLIT).cast("bigint")
    rest = F.call_function("div", units, split)
    parts = (units % split, rest % split, F.call_function("div", rest, split))
    total = None
    for place, part in enumerate(parts):
        summed = F.try_sum(part)
        over = F.raise_error(F.lit("a part of the sum is beyond bigint"))
        checked = F.when(summed.isNotNull() | (F.count(units) == 0), summed).otherwise(over.cast("bigint"))
        scaled = checked.cast("decimal(20,0)") * F.lit(_SPLIT**place).cast("decimal(13,0)")
        total = scaled if total is None else total + scaled
    return total.cast("decimal(38,0)")
