"""

It proves the path from Parquet through Spark to the DuckDB comparison. It is
not an operator of the reference and stands for no coverage. Prices and discounts
with more than two decimals raise an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions import exact_sum, hundredths, product
from tarnfield.sources import read_table

# Eighteen digits before the point and four behind it; the SQL reaches the exact sum
# by a way of its own, which checks exact_sum rather than echoes it.
SQL = """
select l_returnflag, l_linestatus,
       sum(l_quantity) as sum_qty,
       cast(round(sum(cast(l_extendedprice as decimal(22,4))
                      * (1 - cast(l_discount as decimal(12,4)))), 2) as double) as revenue,
       count(*) as n
from lineitem
where l_shipdate <= timestamp '2001-01-01 00:00:00'
group by l_returnflag, l_linestatus
"""


def harness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, revenue and row count per return flag and line status.

    One scan of six columns, then one shuffle that carries one row per group
    and map task, whatever the input size or the skew of the groups.
    """
    lines = read_table(spark, sf_dir, "lineitem")
    # timestamp_ntz like the column, so the session time zone has no say.
    cutoff = F.expr("timestamp_ntz '2001-01-01 00:00:00'")
    # Price and discount are both in hundredths, so their product counts
    # ten-thousandths.
    revenue = product(hundredths(F.col("l_extendedprice")), 100 - hundredths(F.col("l_discount")))
    # Computed once a row; the sum reads it several times.
    sold = lines.where(F.col("l_shipdate") <= cutoff).select("l_returnflag", "l_linestatus", "l_quantity", revenue.alias("units"))
    return sold.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),  # exact for whole quantities, as all given ones are
        F.round(exact_sum(F.col("units")) / 10_000, 2).cast("double").alias("revenue"),
        F.count("*").alias("n"),
    )
