import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from support import DATA, SCALES, duckdb_relation, formatted_plan, rows, shuffled_rows
from tarnfield.plans.harness_check import SQL, harness_check
from tarnfield.sources import read_table

SURVEY_SQL = """
select l_returnflag, l_linestatus,
       sum(l_quantity) as sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue,
       count(*) as n
from lineitem
where l_shipdate <= timestamp '2001-01-01 00:00:00'
group by l_returnflag, l_linestatus
"""

CUTOFF = dt.datetime(2001, 1, 1)
LINE = (
    "l_quantity double, l_extendedprice double, l_discount double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


def brute_force(lines):
    """Exact result in plain Python; ``lines`` are rows shaped like LINE."""
    groups = {}
    for qty, price, discount, flag, status, shipped in lines:
        if shipped is None or shipped > CUTOFF:
            continue
        g = groups.setdefault((flag, status), [0.0, Decimal(0), 0])
        g[0] += qty
        g[1] += Decimal(str(price)) * (1 - Decimal(str(discount)))
        g[2] += 1
    cent = Decimal("0.01")
    return sorted(
        (*k, q, float(r.quantize(cent, rounding=ROUND_HALF_UP)), n) for k, (q, r, n) in groups.items()
    )


def stored(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("scale", SCALES)
@pytest.mark.parametrize("sql", [SQL, SURVEY_SQL], ids=["oracle", "survey"])
def test_matches_duckdb(spark, scale, sql):
    sf_dir = str(DATA / scale)
    got, want = harness_check(spark, sf_dir), duckdb_relation(sf_dir, sql)
    assert got.columns == want.columns
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "double", "double", "bigint"]
    assert [str(t) for t in want.types] == ["VARCHAR", "VARCHAR", "DOUBLE", "DOUBLE", "BIGINT"]
    assert rows(got) == sorted(want.fetchall())


@pytest.mark.parametrize("scale", SCALES[:2])
def test_matches_brute_force(spark, scale):
    sf_dir = str(DATA / scale)
    cols = [c.split()[0] for c in LINE.split(", ")]
    lines = duckdb_relation(sf_dir, f"select {', '.join(cols)} from lineitem").fetchall()
    assert rows(harness_check(spark, sf_dir)) == brute_force(lines)


def test_cutoff_is_inclusive_to_the_microsecond(spark, tmp_path):
    tick = dt.timedelta(microseconds=1)
    lines = [
        (1.0, 10.0, 0.0, "A", "F", CUTOFF - tick),
        (2.0, 20.0, 0.1, "A", "F", CUTOFF),
        (4.0, 40.0, 0.0, "A", "F", CUTOFF + tick),
        (8.0, 80.0, 0.0, "A", "F", None),
    ]
    sf_dir = stored(spark, tmp_path, spark.createDataFrame(lines, LINE))
    assert rows(harness_check(spark, sf_dir)) == [("A", "F", 3.0, 28.0, 2)] == brute_force(lines)


def test_half_cents_round_up(spark, tmp_path):
    lines = [(1.0, 0.10, 0.05, "A", "F", CUTOFF), (1.0, 0.01, 0.0, "N", "F", CUTOFF)]
    sf_dir = stored(spark, tmp_path, spark.createDataFrame(lines, LINE))
    got = rows(harness_check(spark, sf_dir))
    assert got == brute_force(lines) == [("A", "F", 1.0, 0.1, 1), ("N", "F", 1.0, 0.01, 1)]
    assert got == sorted(duckdb_relation(sf_dir, SQL).fetchall())


def test_null_amounts_and_null_keys(spark, tmp_path):
    lines = [
        (None, None, 0.1, "A", "F", CUTOFF),
        (2.0, 5.0, None, None, "F", CUTOFF),
        (3.0, 7.0, 0.0, None, "F", CUTOFF),
    ]
    sf_dir = stored(spark, tmp_path, spark.createDataFrame(lines, LINE))
    got = {tuple(r) for r in harness_check(spark, sf_dir).collect()}
    assert got == {("A", "F", None, None, 1), (None, "F", 5.0, 7.0, 2)}
    assert got == set(duckdb_relation(sf_dir, SQL).fetchall())


def test_empty_table(spark, tmp_path):
    sf_dir = stored(spark, tmp_path, spark.createDataFrame([], LINE))
    assert rows(harness_check(spark, sf_dir)) == []


def test_session_time_zone_does_not_matter(spark):
    sf_dir = str(DATA / "sf0.01")
    want = rows(harness_check(spark, sf_dir))
    try:
        for zone in ("America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert rows(harness_check(spark, sf_dir)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_row_order_and_file_layout_do_not_matter(spark, tmp_path):
    lines = read_table(spark, str(DATA / "sf0.1"), "lineitem")
    want = rows(harness_check(spark, str(DATA / "sf0.1")))
    for i, layout in enumerate([lines.orderBy("l_extendedprice"), lines.repartition(13, "l_partkey")]):
        base = tmp_path / str(i)
        layout.write.parquet(str(base / "lineitem.parquet"))
        assert rows(harness_check(spark, str(base))) == want


def test_hot_group_adds_no_shuffle_rows(spark, tmp_path):
    lines = read_table(spark, str(DATA / "sf0.1"), "lineitem").repartition(16)
    hot = F.col("l_orderkey") % 3 == 0
    skewed = lines.withColumn("l_returnflag", F.when(hot, "A").otherwise(F.col("l_returnflag"))).withColumn(
        "l_linestatus", F.when(hot, "F").otherwise(F.col("l_linestatus"))
    )
    sf_dir = stored(spark, tmp_path, skewed)
    df = harness_check(spark, sf_dir)
    assert rows(df) == sorted(duckdb_relation(sf_dir, SQL).fetchall())
    tasks = read_table(spark, sf_dir, "lineitem").rdd.getNumPartitions()
    assert tasks > 1
    (moved,) = shuffled_rows(harness_check(spark, sf_dir))
    assert 6 <= moved <= 6 * tasks


def test_plan_reads_six_columns_and_shuffles_once(spark):
    plan = formatted_plan(harness_check(spark, str(DATA / "sf0.01")))
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema: "))
    assert sorted(c.split(":")[0] for c in read[len("ReadSchema: struct<") : -1].split(",")) == sorted(
        c.split()[0] for c in LINE.split(", ")
    )
    assert "LessThanOrEqual(l_shipdate,2001-01-01T00:00)" in plan
    assert "cast(l_shipdate" not in plan
    assert plan.count(") Exchange") == 1
    assert plan.index("[partial_sum(l_quantity") < plan.index(") Exchange\n")
    assert "Python" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_large_prices_match_the_oracle_and_third_decimals_raise(spark, tmp_path):
    line = (1.0, 2e10, 0.0, "A", "F", dt.datetime(1999, 1, 1))
    sf_dir = stored(spark, tmp_path, spark.createDataFrame([line] * 3, LINE))
    assert rows(harness_check(spark, sf_dir)) == duckdb_relation(sf_dir, SQL).fetchall() == [("A", "F", 3.0, 6e10, 3)]
    for price, discount in ((0.125, 0.0), (100.0, 0.125)):
        odd = spark.createDataFrame([(1.0, price, discount, *line[3:])] * 10, LINE)
        base = tmp_path / f"{price}"
        odd.write.parquet(str(base / "lineitem.parquet"))
        with pytest.raises(Exception, match="no amount in whole hundredths"):
            harness_check(spark, str(base)).collect()


def test_driver_contract(spark):
    assert "harness_check" in contract.oracle_sql().keys() <= contract.queries().keys()
    df = contract.entry(spark)
    assert df.columns == ["l_returnflag", "l_linestatus", "sum_qty", "revenue", "n"]
    assert df.count() == 6
