"""Operator 6, quality rules: counts within a text, and lines frequent across a host.

Lines are normalised (lower case, single spaces, each digit 0) and hashed. For
each host, here ``source``, the distinct documents that hold a line are counted;
documents of the same text count once, so copies alone make no line frequent.
A line is above the limit when it is in ``short_docs`` of them, or in ``long_docs``
if it has ``long_words`` words or more, however large the host is; and also when it
is in at least ``min_docs`` and more than ``host_share`` of them. Such lines are removed, and a document is
rejected when it fails the base rules or fewer than ``left_share`` of its words
remain.

Defined results: a null text counts as empty and fails the base rules; a null
host is the host of the empty name; repeated rows each come back with the same
result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import packed, salted_join, slices, stored, utf8, windows, words
from tarnfield.llm.common import span_hashes
from tarnfield.sources import read_table

SYMBOLS = "#*$%&|<>"
WINDOW = 8

_DIGITS = re.compile(r"\d")

MEASURED = (
    "doc_id bigint, row_key bigint, text_key bigint, host string, n_words bigint, word_chars bigint,"
    " n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<line:bigint,words:bigint,length:bigint>>"
)


_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64()), ("length", pa.int64())]))


def line_key(line: str) -> int | None:
    """Signed 64-bit hash of a normalised line; None for a line without a word."""
    plain = " ".join(line.lower().split())
    if not plain:
        return None
    return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", plain)) - (1 << 63)


def _repeated(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, and those inside a window that the row holds twice or more."""
    starts, ends, rows = words(data, offsets)
    counts = np.diff(rows)
    runs, bounds = windows(span_hashes(data, starts, ends), rows, WINDOW)
    row = np.repeat(np.arange(len(counts)), np.diff(bounds))
    keys = runs ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    found = np.flatnonzero(twice)
    first = rows[:-1][row[found]] + found - bounds[:-1][row[found]]
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
    return counts, covered[rows[1:]] - covered[rows[:-1]]


_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_IS_INK = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 4):
            data, offsets = utf8(batch.column(4))
            n_words, repeat = _repeated(data, offsets)
            per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            dups, lines = [], []
            for text in batch.column(4).to_pylist():
                seen, own, length, dup = set(), {}, {}, 0
                for line in (text or "").split("\n"):
                    n = len(line.encode().split())
                    if n:
                        dup += line in seen
                        seen.add(line)
                        key = line_key(line)
                        if key is not None:
                            own[key] = own.get(key, 0) + n
                            length[key] = max(n, length.get(key, 0))
                dups.append(dup)
                lines.append([{"line": k, "words": n, "length": length[k]} for k, n in own.items()])
            counts = [n_words, per_row(_IS_INK[data] & ((data & 0xC0) != 0x80)), per_row(_IS_SYMBOL[data]), dups, repeat]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *(pa.array(x, pa.int64()) for x in counts), pa.array(lines, _LINES)],
                ["doc_id", "row_key", "text_key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def with_row_key(documents: DataFrame, number: Column | None = None) -> DataFrame:
    """``doc_id``, ``text``, host, the number of the row, and a hash that names its text."""
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.monotonically_increasing_id() if number is None else number).alias("row_key"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.coalesce("source", F.lit("")).alias("host"),
        F.col("text"),
    )


def judge(
    documents: DataFrame,
    spark: SparkSession,
    number: Column | None = None,
    min_docs: int = 20,
    host_share: float = 0.1,
    left_share: float = 0.3,
    short_docs: int = 100,
    long_docs: int = 20,
    long_words: int = 50,
) -> DataFrame:
    """Counts and verdict of each row of ``documents(doc_id, text, source)``.

    Adds ``row_key`` (``number``, if given), ``removed_lines`` (hashes of normalised lines above the
    limit, null if none) and ``removed_words``.
    """
    measured = stored(with_row_key(documents, number).mapInArrow(_measure, MEASURED), spark)
    of_line = measured.select("row_key", "text_key", "host", F.explode("lines").alias("l")).select("row_key", "text_key", "host", "l.*")
    hosts = measured.groupBy("host").agg(F.count_distinct("text_key").alias("host_docs"))
    often = of_line.groupBy("host", "line").agg(F.count_distinct("text_key").alias("docs"), F.max("length").alias("length"))
    often = often.where(F.col("docs") >= min(min_docs, short_docs, long_docs))
    many = F.col("docs") >= F.when(F.col("length") >= long_words, long_docs).otherwise(short_docs)
    large = (F.col("docs") >= min_docs) & (F.col("docs") > host_share * F.col("host_docs"))
    above = salted_join(often, hosts, ["host"], F.col("line")).where(many | large).select("host", "line")
    removed = (
        salted_join(of_line, stored(above, spark), ["host", "line"], F.col("row_key"))
        .groupBy("row_key")
        .agg(F.collect_set(F.struct("line", "words")).alias("cut"))
        .select(
            "row_key",
            F.transform("cut", lambda c: c["line"]).alias("removed_lines"),
            F.aggregate("cut", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]).alias("removed_words"),
        )
    )
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    removed_words = F.coalesce("removed_words", F.lit(0).cast("bigint"))
    return (
        measured.drop("lines", "text_key", "host")
        .join(removed, "row_key", "left")
        .withColumn("removed_words", removed_words)
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= left_share * F.col("n_words")))
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for k, cut in enumerate(batch.column("removed_lines").to_pylist()):
            if cut:
                gone = set(cut)
                texts[k] = "\n".join(x for x in texts[k].split("\n") if line_key(x) not in gone)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "left"])


def filtered(documents: DataFrame, spark: SparkSession, **limits) -> DataFrame:
    """The rows of ``documents`` that pass, all their columns, without lines above the limit."""
    docs = packed(documents, spark)
    verdict = judge(docs.select("nr", "doc.doc_id", "doc.text", "doc.source"), spark, F.col("nr"), **limits)
    kept = docs.join(verdict.where("kept").select(F.col("row_key").alias("nr"), "removed_lines"), "nr")
    left = kept.select("doc", "doc.text", "removed_lines").mapInArrow(_without, docs.select("doc", F.lit("").alias("left")).schema)
    return left.select(F.col("doc").withField("text", F.col("left")).alias("doc")).select("doc.*")


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row of ``documents``."""
    return judge(read_table(spark, sf_dir, "documents"), spark).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


#: The same over tables whose ids are unique.
SQL = """
with d as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
runs as (
  select doc_id, i, count(*) over (partition by doc_id, array_to_string(ws[i:i + 7], ' ')) as n
  from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from d)),
repeats as (select doc_id, count(distinct i + k) as n from runs, range(8) r(k) where n > 1 group by doc_id),
lines as (
  select doc_id, host, t, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) as n,
         regexp_replace(trim(regexp_replace(lower(l), '\\s+', ' ', 'g')), '[0-9]', '0', 'g') as norm
  from (select doc_id, host, t, unnest(string_split(t, chr(10))) as l from d)
  where regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dups as (select doc_id, sum(c - 1) as n from (select doc_id, l, count(*) as c from lines group by doc_id, l) group by doc_id),
hosts as (select host, count(distinct t) as n from d group by host),
above as (
  select host, norm from (select host, norm, count(distinct t) as c, max(n) as words from lines group by host, norm) join hosts using (host)
  where c >= case when words >= 50 then 20 else 100 end or c >= 20 and c > 0.1 * n),
removed as (select doc_id, sum(n) as n from lines join above using (host, norm) group by doc_id),
m as (
  select d.doc_id, len(ws)::bigint as n_words, len(array_to_string(ws, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dups.n, 0)::bigint as n_dup_lines,
         coalesce(repeats.n, 0)::bigint as n_repeat_words, coalesce(removed.n, 0)::bigint as removed_words
  from d left join dups using (doc_id) left join repeats using (doc_id) left join removed using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - removed_words >= 0.3 * n_words as kept
from m
"""
