"""The Parquet tables every job reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read ``<base>/<name>.parquet``, one file or a directory of files.

    ``base`` may be any URI the cluster's file systems understand.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {', '.join(TABLES)}")
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
