"""Operator 13, ranked lexical search by the Best Position Algorithm.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
in lower case. Numbers of documents and terms, and the documents that hold each term,
are counted over all texts. Every document keeps its length and how often it holds the
terms of the queries.

Tasks read these in slices of about SLICE postings. For each term a slice has a list of
its documents by falling impact, what the term adds to a score. A query reads its lists
a few places at a time. A document met for the first time is looked up in all of them
(direct access): that gives its whole score and marks its place in every list. In each
list, the places from the top to the first one not marked are known, also where
direct access, not reading, marked them. No document unseen can score more than the
sum of the impacts at those first unknown places; the search of a slice ends when that
sum is strictly below the k-th score found, so no tie is lost. The best k of all slices
are the result.

Queries go in blocks of about BLOCK_BYTES of text, with one pass over the documents for
each, so that a block's terms fit every task. Terms are told apart by 64-bit hashes.

Defined results: a null or empty text has no terms and is in no list; a document
without terms is not counted; each row of the items is a query of its own, one without
terms, or with none that a document holds, has no rows; repeated documents and null ids
are documents of their own, equal scores by id with null last; an empty table on
either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.llm.bpe import ragged
from tarnfield.llm.common import slices, span_hashes, stored, utf8, words
from tarnfield.sources import read_table

TOP = 20
#: Bytes of the queries of a block, and postings of a slice.
BLOCK_BYTES, SLICE = 4 << 20, 1_500_000
#: Places that a query reads of each list at first; twice as many each further time.
STEP = 4

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = np.array([TERM.match(bytes([b])) is None for b in range(256)])
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32

MEASURED = "doc_id bigint, n bigint, terms array<int>, times array<int>"


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term, and for each row the index of its first."""
    data = _SMALL[data]
    starts, ends, rows = words(data, offsets, _GAP)
    return span_hashes(data, starts, ends), rows


class Queries:
    """The queries of a block: their terms by hash, and the terms of each with their repeats."""

    def __init__(self, texts: list[str | None]):
        hashes, rows = term_hashes(*utf8(pa.array(texts, pa.string())))
        self.hashes, number = np.unique(hashes, return_inverse=True)
        self.own = []
        for a, b in zip(rows, rows[1:]):
            terms, times = np.unique(number[a:b], return_counts=True)
            self.own.append((terms, times.astype(np.int64)))


def _measure(hashes: np.ndarray):
    """A task that gives each document's number of terms, and those of the queries it holds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                found, rows = term_hashes(*utf8(batch.column(1)))
                n = np.diff(rows)
                at = np.minimum(np.searchsorted(hashes, found), max(0, len(hashes) - 1))
                hit = np.flatnonzero(hashes[at] == found) if len(hashes) else np.empty(0, np.int64)
                doc = np.repeat(np.arange(len(n)), n)[hit]
                codes, times = np.unique(doc * np.int64(max(1, len(hashes))) + at[hit], return_counts=True)
                offsets = pa.array(np.searchsorted(codes, np.arange(len(n) + 1) * max(1, len(hashes))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (codes % max(1, len(hashes)), times)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "times"])

    return task


def _holding(size: int):
    """A task that counts the documents that hold each term."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros(size, np.int64)
        for batch in batches:
            docs += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        term = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(docs[term])], ["term", "docs"])

    return task


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of all documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Lists:
    """The impact lists of a slice of documents."""

    def __init__(self, names: np.ndarray, nameless: np.ndarray, n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, total: int, documents: int):
        self.names, self.nameless, self.bounds, self.terms = names, nameless, bounds, terms
        doc = np.repeat(np.arange(len(n)), np.diff(bounds))
        m = 75 + 25 * n * documents // max(1, total)
        times = times.astype(np.int64)
        self.impact = weights[terms] * (1_000_000_000 * times // (1000 * times + 12 * m[doc]))
        order = np.lexsort((-self.impact, terms))
        self.by_impact = np.append(self.impact[order], 0)
        self.doc_at = doc[order]
        self.place = np.empty(len(order), np.int64)  # of a document's posting, in the lists
        self.place[order] = np.arange(len(order))
        self.first = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.share = np.zeros(len(weights), np.int64)
        self.accesses = 0

    def best(self, terms: np.ndarray, times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with the ``most`` highest scores for a query, best first, and the scores."""
        start, end = self.first[terms], self.first[terms + 1]
        there = end > start
        terms, times, at, end = terms[there], times[there], start[there].copy(), end[there]
        known = np.zeros(len(self.place) + 1, bool)  # places that are seen
        met = np.zeros(len(self.names), bool)
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        self.share[terms] = times
        step = STEP
        while len(at) and (at < end).any():
            read = np.minimum(step, end - at)
            places = ragged(at, read)
            fresh = np.unique(self.doc_at[places[~known[places]]])
            fresh = fresh[~met[fresh]]
            if len(fresh):
                met[fresh] = True
                size = self.bounds[fresh + 1] - self.bounds[fresh]
                posting = ragged(self.bounds[fresh], size)
                share = self.share[self.terms[posting]]
                known[self.place[posting[share > 0]]] = True
                self.accesses += len(posting)
                sums = np.add.reduceat(share * self.impact[posting], np.cumsum(size) - size)
                docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, sums])
                if len(docs) > most:
                    order = np.lexsort((self.names[docs], self.nameless[docs], -scores))[:most]
                    docs, scores = docs[order], scores[order]
            at = at + read
            for k in np.flatnonzero((at < end) & known[at]):  # on to the first place not seen
                beyond = known[at[k] : end[k]]
                at[k] += len(beyond) if beyond.all() else int(beyond.argmin())
            bound = int((times * np.where(at < end, self.by_impact[at], 0)).sum())
            if bound == 0 or len(docs) >= most and bound < scores.min():
                break
            step *= 2
        self.share[terms] = 0
        order = np.lexsort((self.names[docs], self.nameless[docs], -scores))
        order = order[scores[order] > 0][:most]
        return docs[order], scores[order]


def _ranked(queries: Queries, weights: np.ndarray, total: int, documents: int, most: int, size: int):
    """A task that gives the best documents of each slice for each query."""

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda k: pa.concat_arrays([p.column(k) for p in parts])
        ids, terms = column(0), column(2)
        bounds = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
        lists = Lists(
            ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), column(1).to_numpy(), bounds, terms.flatten().to_numpy(), column(3).flatten().to_numpy(), weights, total, documents
        )
        rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, own in enumerate(queries.own):
            docs, scores = lists.best(*own, most)
            for out, x in zip(rows, (np.full(len(docs), k), docs, scores)):
                out.append(x)
        nth, docs, scores = (np.concatenate(x) for x in rows)
        return pa.RecordBatch.from_arrays([pa.array(nth.astype(np.int32)), ids.take(pa.array(docs)), pa.array(scores)], ["nth", "doc_id", "score"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            if batch.num_rows:
                held.append(batch)
                many += len(batch.column(2).flatten())
            if many >= size:
                yield found(held)
                held, many = [], 0
        if held:
            yield found(held)

    return task


def searched(items: DataFrame, documents: DataFrame, spark: SparkSession, top: int = TOP, block_bytes: int = BLOCK_BYTES, size: int = SLICE) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best of ``documents(doc_id, text)`` for each of ``items(item_id, text)``."""
    rows = stored(items.select(F.monotonically_increasing_id().alias("nr"), F.col("item_id").cast("bigint").alias("item_id"), "text"), spark)
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = []
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("nr"), F.lit(blocks)) == block).collect()
        queries = Queries([r.text for r in own])
        measured = stored(texts.mapInArrow(_measure(queries.hashes), MEASURED), spark)
        documents_, total = measured.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(queries.hashes), np.int64)
        for r in measured.select("terms").mapInArrow(_holding(len(weights)), "term int, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
            weights[r.term] = weight(documents_, r.docs)
        found = stored(measured.mapInArrow(_ranked(queries, weights, total, documents_, top, size), "nth int, doc_id bigint, score bigint"), spark)
        names = spark.createDataFrame([(k, r.nr, r.item_id) for k, r in enumerate(own)], "nth int, nr bigint, item_id bigint")
        parts.append(found.join(names, "nth").drop("nth"))
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    order = Window.partitionBy("nr").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of ``documents`` for each item of ``benchmark``."""
    return searched(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"), spark)


#: Over tables whose ids are unique.
SQL = r"""
with d as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
q as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
n as (select doc_id, count(*) as n from d group by doc_id),
g as (select count(*)::bigint as docs, sum(n)::bigint as total from n),
f as (select doc_id, term, count(*) as tf from d group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, g group by term, docs),
i as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))) as impact
  from f join n using (doc_id) join w using (term), g),
s as (select item_id, doc_id, sum(impact)::bigint as score from q join i using (term) group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
"""
