"""Helpers for comparing Spark results and reading Spark plans."""

from __future__ import annotations

import contextlib
import io
from pathlib import Path

import duckdb

from tarnfield.sources import TABLES

DATA = Path("/root/testdata")
SCALES = ("sf0.001", "sf0.01", "sf0.1")


def duckdb_relation(sf_dir, sql):
    """Run ``sql`` in DuckDB with every table as a view over its Parquet file."""
    db = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            source = path / "*.parquet" if path.is_dir() else path
            db.execute(f"create view {name} as select * from '{source}'")
    return db.sql(sql)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def formatted_plan(df):
    """What ``df.explain("formatted")`` prints; nothing in it is cut short."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def shuffled_rows(df):
    """Rows written to each shuffle while running ``df``."""
    df.collect()
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found
