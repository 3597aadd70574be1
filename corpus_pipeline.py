"""From raw documents to token ids: five stages, each one operator of ``tarnfield.llm``.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the one before kept,
and is written as Parquet before the next one reads it. All but the last return the
columns of ``documents``; ``n_chars`` follows the text.

What a stage has stored for itself goes when the next one is called, unless that one's
``docs`` still read it; so write a stage's result before calling the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm import bpe, jaccard, mixing, pii, quality
from tarnfield.llm.common import recorded, removed, stored
from tarnfield.sources import read_table

#: Near copies, the mix and BPE have no form in SQL.
ORACLE_SQL = None


#: What the last stage has stored for itself.
_SCRATCH: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _SCRATCH and not any(path.rpartition("/")[2] in name for name in docs.inputFiles() for path in _SCRATCH):
            removed(_SCRATCH, spark)
            _SCRATCH.clear()
        with recorded() as paths:
            out = work(spark, docs, sf_dir)
        _SCRATCH.extend(paths)
        return out

    return stage


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines frequent across their host."""
    return _with_length(quality.filtered(docs, spark))


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the smallest id."""
    return jaccard.one_of_each(docs, spark)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with general terms in place of personal data."""
    return _with_length(pii.sanitised(docs, spark))


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs, spark)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every document of the mix."""
    ids = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("source mix", source_mix),
    ("BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), spark)
    return docs
