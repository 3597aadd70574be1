"""Operator 5, mixing sources to target weights by capped water-filling.

DataFrame functions only. Sources, ordered by code point with null last, weigh
1, 2, 3, repeating, and share ``total`` words by weight. A source whose share
would pass ``max_epochs`` times its size is clamped there; the excess goes to
the others by weight, until none is above. A source then takes each document
``floor(target / size)`` times, and once more the documents that come first in a
seeded order, up to the words still missing.

Defined results: a null or empty text has size 0 and is taken 0 times its size;
null is a source of its own; ids may be null or repeat: every row is mixed on its
own, in an order by id, size and text, so that a rerun gives the same rows; an empty
table gives an empty result; other columns are ignored, and kept by ``repeated``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import packed, salted_join, stored
from tarnfield.sources import read_table

SEED = "mix-1"


def sized(documents: DataFrame, number: Column) -> DataFrame:
    """Size in words and place in the seeded order of every row; ``nr`` is ``number``, null if rows need no name."""
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").isNull().alias("last"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
        number.alias("nr"),
        F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("place"),
        F.xxhash64("text").alias("tie"),
    )


def _prefix(rows: DataFrame, spark: SparkSession, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Running sums within ``keys``, the row itself left out; ``values`` gives the name of each column's.

    Rows are range-partitioned by keys and order, so a hot key spans many
    partitions. Each partition sums its own part; the sums of the partitions
    before it, one row per key and partition, are added.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, spark)
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part", *keys).agg(*(F.sum(c).alias(f"_sum_{c}") for c in values))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *keys, *(F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_earlier_{c}") for c in values))
    within = ranged.withColumns({name: F.coalesce(F.sum(c).over(own), F.lit(0)) for c, name in values.items()})
    joined = within.join(parts, ["_part", *keys])
    return joined.withColumns({name: F.col(name) + F.col(f"_earlier_{c}") for c, name in values.items()}).drop("_part", *(f"_earlier_{c}" for c in values))


def targets(sources: DataFrame, spark: SparkSession, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets for ``sources(last, source, size)``, one row each, by water-filling.

    Sources by rising cap per weight are clamped one after the other. With those before
    it clamped, a source leaves a level for itself and the rest; the first one whose cap
    lies at its level or above ends that, and its level is the water's. So running sums
    of caps and weights give it at once, and one row comes to the driver.
    """
    ranked = _prefix(sources.withColumn("_one", F.lit(1).cast("bigint")), spark, [], ["last", "source"], {"_one": "before"})
    turn = F.pmod(F.col("before"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), turn + 1)
    cap = F.col("size") * max_epochs
    ranked = ranked.select("last", "source", "size", weight.alias("weight"), cap.alias("cap"), (cap.cast("double") / weight).alias("reach"))
    summed = _prefix(ranked, spark, [], ["reach", "last", "source"], {"cap": "clamped", "weight": "passed"})
    total, weights_all = summed.agg(F.sum("size"), F.sum("weight")).first()
    level = (F.lit(total) - F.col("clamped")).cast("double") / (F.lit(weights_all) - F.col("passed")).cast("double")
    first = summed.where(F.col("reach") >= level).agg(F.min(F.struct("reach", "last", "source", level.alias("level"))).alias("row")).first().row
    share = F.lit(first.level) * F.col("weight") if first else F.col("cap").cast("double")
    return summed.withColumn("target", F.least(F.col("cap").cast("double"), share))


def mixed(documents: DataFrame, spark: SparkSession, number: Column | None = None, **options) -> DataFrame:
    """How often each row is taken: ``copies``, with its size and its source's target."""
    rows = stored(sized(documents, F.lit(None).cast("bigint") if number is None else number), spark)
    summed = _prefix(rows, spark, ["last", "source"], ["place", "size", "doc_id", "tie"], {"size": "before"})
    sources = rows.groupBy("last", "source").agg(F.sum("size").alias("size"))
    goals = targets(sources, spark, **options).select("last", "source", F.col("size").alias("source_size"), "target")
    joined = salted_join(summed, goals, ["last", "source"], F.col("place"))
    whole = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("bigint")
    missing = F.col("target") - whole * F.col("source_size")
    # the row on the edge is taken when that brings the sum nearer to the target
    extra = (F.col("before") + F.col("size") / 2 <= missing) & (missing > 0)
    return joined.withColumn("copies", whole + F.when(extra, 1).otherwise(0))


def repeated(documents: DataFrame, spark: SparkSession, **options) -> DataFrame:
    """The mix itself: rows of ``documents``, each as often as it is taken."""
    docs = packed(documents, spark)
    taken = mixed(docs.select("nr", "doc.doc_id", "doc.text", "doc.source"), spark, F.col("nr"), **options).where("copies > 0").select("nr", "copies")
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return docs.join(taken, "nr").select("doc", times.alias("nth")).select("doc.*")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every row of ``documents``, with size and target of its source."""
    return mixed(read_table(spark, sf_dir, "documents"), spark).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    )


#: The level is where caps and shares balance: sources by cap per weight, the
#: first k clamped, and the smallest k for which no other lies under the level.
SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5('mix-1:' || coalesce(doc_id::varchar, '')) as place
  from documents),
s as (select source, sum(size)::bigint as size from d group by source),
w as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight, 3 * size as cap from s),
o as (select *, row_number() over (order by cap::double / weight, source nulls last) as k from w),
p as (select k, coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0) as clamped,
             sum(weight) over (order by k rows between current row and unbounded following) as open_weight,
             cap::double / weight as reach, (select sum(size) from w) as total from o),
l as (select min(k) as k from p where reach >= (total - clamped)::double / open_weight::double),
f as (select (total - clamped)::double / open_weight::double as level from p join l using (k)),
t as (select source, size as source_size, least(cap::double, (select level from f) * weight) as target from w),
e as (select d.*, t.source_size, t.target,
             coalesce(sum(d.size) over (partition by d.source order by d.place, d.size, d.doc_id nulls first rows between unbounded preceding and 1 preceding), 0) as before,
             case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as whole
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * (whole + case when before + size / 2.0 <= target - whole * source_size and target - whole * source_size > 0 then 1 else 0 end))::bigint as taken
from e
"""
