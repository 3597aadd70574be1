from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from support import rows
from tarnfield.functions import exact_sum, hundredths, product

BIG = 2**63 - 1


def test_hundredths_of_every_cent_value(spark):
    # x/100 is the double nearest to each amount; both signs, all cents to 110,000.00
    cents = spark.range(-11_000_000, 11_000_001)
    off = cents.where(hundredths(F.col("id").cast("double") / 100) != F.col("id"))
    assert off.count() == 0


def test_hundredths_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (1.23,)], "v double")
    assert [r[0] for r in df.select(hundredths(F.col("v"))).collect()] == [None, 123]


def test_exact_sum_goes_past_bigint(spark):
    df = spark.createDataFrame([(BIG,), (BIG,), (BIG,)], "v bigint")
    assert df.agg(exact_sum(F.col("v"))).first()[0] == Decimal(3 * BIG)


def test_exact_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("b", None)], "k string, v bigint")
    assert rows(df.groupBy("k").agg(exact_sum(F.col("v")))) == [("a", None), ("b", Decimal(1))]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-BIG - 1, BIG)), min_size=1, max_size=60))
def test_exact_sum_matches_python(spark, data):
    want = {}
    for k, v in data:
        want[k] = want.get(k, 0) + v
    df = spark.createDataFrame(data, "k string, v bigint").repartition(5)
    got = {k: int(v) for k, v in df.groupBy("k").agg(exact_sum(F.col("v"))).collect()}
    assert got == want


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("value", [0.125, 5.001, float("nan"), float("inf"), float("-inf"), 1e15, -1e300])
def test_hundredths_refuses_what_is_not_whole(spark, ansi, value):
    df = spark.createDataFrame([(value,)], "v double")
    with pytest.raises(Exception, match="no amount in whole hundredths"):
        df.select(hundredths(F.col("v"))).collect()


def test_hundredths_keeps_cents_with_ansi_on_and_off(spark, ansi):
    df = spark.createDataFrame([(None,), (1.23,), (-0.07,), (9e13,)], "v double")
    assert [r[0] for r in df.select(hundredths(F.col("v"))).collect()] == [None, 123, -7, 9 * 10**15]


def test_product_raises_beyond_bigint(spark, ansi):
    df = spark.createDataFrame([(3, None, 0), (3, -4, -12)], "a bigint, b bigint, c bigint")
    assert [r[0] for r in df.select(product(F.col("a"), F.col("b"))).collect()] == [None, -12]
    with pytest.raises(Exception, match="product beyond bigint"):
        spark.createDataFrame([(BIG, 2)], "a bigint, b bigint").select(product(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize("value", [BIG, -BIG - 1])
def test_exact_sum_of_a_million_extremes(spark, ansi, value):
    df = spark.range(1_200_000).select(F.lit(value).cast("bigint").alias("v"))
    assert df.agg(exact_sum(F.col("v"))).first()[0] == Decimal(1_200_000 * value)
