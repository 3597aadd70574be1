"""Operator 10, personal data: fixed patterns, and terms that reveal what they found.

An entity is a distinct value found by a pattern. Words of the documents that hold
it may reveal it even after it is gone. How strongly word t reveals entity e is their pointwise mutual
information, log(p(e, t) / (p(e) p(t))), against all that there is to know of e,
its information content -log p(e), with probabilities estimated by distinct texts,
so that copies are no evidence. A word that gives ``share`` of the content or more,
and stands with e in at least ``support`` texts, is above the disclosure threshold:
each of its occurrences is a span in every document that holds e. An entity of one
text has no such word, as every rare word of that text would do alike.

``sanitised`` puts a general term in place of what was found: the kind of an
entity, NAME for a capitalised word; other words go.

Defined results: a null or empty text has no spans and stays as it is; texts of any
length are read whole, in linear time, but a text with n entities that recur in other
texts gives out each of its distinct words n times; repeated rows and null ids come back row by
row; an empty table gives an empty result; other columns are ignored, and kept by
``sanitised``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import bitmap, packed, salted_join, slices, stored
from tarnfield.llm.langid import Words
from tarnfield.sources import read_table

KINDS = ("email", "ip", "card", "phone", "term")
SHARE, SUPPORT = 0.8, 2
FILTER = 1 << 23
#: Pairs of entity and word that a task gives out at once.
PAIRS = 50_000
#: Distinct words that a task counts before it gives the counts out.
HELD = 200_000
#: Bytes of text whose words a task counts at once, long texts apart.
COUNTED_BYTES = 1_000_000

# The patterns. A match of an address begins where its run of letters or
# digits begins, so runs are looked at once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done))
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that fit, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _plain(word: str) -> str:
    return word.lower() if word.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in word)


def entity(text: str, start: int, kind: int, end: int) -> int:
    """A hash that names the value of a span, however it is written."""
    value = text[start:end].lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else r"[^0-9]", "", text[start:end])
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") - (1 << 63)


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of all words of a text that touch none of its spans."""
    starts, ends = [a for a, _, _ in spans], list(accumulate((b for _, _, b in spans), max))
    for m in WORD.finditer(text):
        opened = bisect_left(starts, m.end())
        if not opened or ends[opened - 1] <= m.start():
            yield _plain(m[0]), m.start(), m.end()


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
#: ``text`` is kept where there are entities.
FOUND = f"doc_id bigint, row_key bigint, text_key bigint, base {_SPANS}, entities array<bigint>, text string"
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def _structs(spans: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    return [dict(zip(("start", "kind", "end"), x)) for x in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 3):
            base, entities, texts = [], [], []
            for text in batch.column(3).to_pylist():
                own = base_spans(text) if text else []
                base.append(_structs(own))
                entities.append(sorted({entity(text, *x) for x in own}))
                texts.append(text if own else None)
            columns = [*batch.columns[:3], pa.array(base, _BASE), pa.array(entities, pa.list_(pa.int64())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "text_key", "base", "entities", "text"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each entity of a text with each distinct word of it."""
    for whole in batches:
        for batch in slices(whole, 1):
            for entities, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = pa.array(sorted({w for w, _, _ in words_outside(text, base_spans(text))}), pa.string())
                for name in entities:
                    for at in range(0, len(words), PAIRS):
                        part = words[at : at + PAIRS]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.int64()), part], ["entity", "word"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of the words that reveal an entity of the text, all over it."""
    for whole in batches:
        for batch in slices(whole, 1):
            spans = []
            for text, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                wanted = set(words)
                spans.append(_structs([(a, KINDS.index("term"), b) for w, a, b in words_outside(text, base_spans(text)) if w in wanted]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _BASE)], ["text_key", "added"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            bucket = np.unique(Words(batch.column(0).to_pylist()).name & np.uint64(FILTER - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket)], ["bucket"])


def _document_counts(wanted: np.ndarray):
    """A task that counts the rows that hold each word that may be wanted, each row ``times`` times.

    ``wanted`` has a bit for each bucket. Counts are summed over the task, and given out
    when there are HELD words.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for whole in batches:
            for batch in slices(whole, 0, COUNTED_BYTES):
                words = Words(batch.column(0).to_pylist())
                bucket = words.name & np.uint64(FILTER - 1)
                pick = (wanted[bucket >> np.uint64(3)] << (bucket & np.uint64(7)).astype(np.uint8) & 0x80).astype(bool)
                row = np.repeat(np.arange(batch.num_rows), np.diff(words.bounds))
                some = pick[words.word]
                size = np.int64(len(words.first) + 1)
                once = np.unique(row[some] * size + words.word[some])
                times = np.zeros(len(words.first), np.int64)
                np.add.at(times, once % size, batch.column(1).to_numpy()[once // size])
                for k in np.flatnonzero(times).tolist():
                    word = words.text(k)
                    held[word] = held.get(word, 0) + int(times[k])
                if len(held) > HELD:
                    yield _counts(held)
                    held = {}
        yield _counts(held)

    return task


def _counts(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "docs"])


def word_counts(rows: DataFrame, spark: SparkSession, bits: np.ndarray) -> tuple[DataFrame, int]:
    """``word, docs``: the distinct texts of ``rows(text_key, text)`` that hold each word, and their number.

    All rows are counted where they are read; then the surplus copies of a text, which
    alone are moved, are taken off again.
    """
    texts = rows.where("text is not null")
    copied = stored(texts.groupBy("text_key").agg((F.count("*") - 1).alias("surplus")).where("surplus > 0"), spark)
    total = texts.count() - (copied.agg(F.sum("surplus")).first()[0] or 0)
    once = texts.join(copied.select("text_key"), "text_key").groupBy("text_key").agg(F.first("text").alias("text"))
    surplus = once.join(copied, "text_key").select("text", (-F.col("surplus")).alias("times"))
    task = _document_counts(bits)
    every = texts.select("text", F.lit(1).cast("bigint").alias("times")).mapInArrow(task, "word string, docs bigint")
    held = every.union(surplus.mapInArrow(task, "word string, docs bigint"))
    return held.groupBy("word").agg(F.sum("docs").alias("docs")), total


def revealing(each: DataFrame, holding: DataFrame, texts: DataFrame, spark: SparkSession, share: float, support: int) -> DataFrame:
    """``(entity, word)`` above the disclosure threshold, by all of ``texts(text_key, text)``.

    ``each(text_key, entity)`` and ``holding(text_key, text)`` are the distinct texts with entities.
    """
    entities = stored(each.groupBy("entity").agg(F.count("*").alias("texts")).where(F.col("texts") >= support), spark)
    own = salted_join(each, entities.select("entity"), ["entity"], F.col("text_key")).groupBy("text_key").agg(F.collect_set("entity").alias("own"))
    pairs = own.join(holding, "text_key").select("own", "text").mapInArrow(_pairs, "entity bigint, word string")
    together = stored(pairs.groupBy("entity", "word").agg(F.count("*").alias("both")).where(F.col("both") >= support), spark)
    bits = bitmap(together.select("word").distinct().mapInArrow(_buckets, "bucket int"), "bucket", FILTER)
    if not bits.any():
        return together.select("entity", "word")
    held, total = word_counts(texts, spark, np.packbits(bits))
    joined = salted_join(salted_join(together, held, ["word"], F.col("entity")), entities, ["entity"], F.col("word"))
    content = F.log(F.lit(float(total)) / F.col("texts"))
    shared = F.log(F.col("both") * float(total) / (F.col("texts") * F.greatest("docs", "both")))
    return joined.where((content > 0) & (shared >= share * content)).select("entity", "word")


def scanned(documents: DataFrame, spark: SparkSession, number: Column | None = None, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """Spans of every row of ``documents(doc_id, text)``: ``base`` and ``all``, as arrays in order.

    ``row_key`` is ``number``, if given.
    """
    key = F.expr("if(text is null, null, xxhash64(text))").alias("text_key")
    number = F.monotonically_increasing_id() if number is None else number
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), number.alias("row_key"), key, "text")
    found = stored(rows.mapInArrow(_scan, FOUND), spark)
    with_any = found.where(F.size("entities") > 0)
    each = stored(with_any.select("text_key", F.explode("entities").alias("entity")).distinct(), spark)
    holding = with_any.groupBy("text_key").agg(F.first("text").alias("text"))
    reveal = stored(revealing(each, holding, rows.select("text_key", "text"), spark, share, support), spark)
    words = reveal.groupBy("entity").agg(F.collect_set("word").alias("words"))
    words = salted_join(each, words, ["entity"], F.col("text_key")).groupBy("text_key").agg(F.array_distinct(F.flatten(F.collect_set("words"))).alias("words"))
    added = holding.join(words, "text_key").select("text_key", "text", "words").mapInArrow(_added, f"text_key bigint, added {_SPANS}")
    out = salted_join(found.drop("entities", "text"), added, ["text_key"], F.col("row_key"), "left").drop("text_key")
    return out.withColumn("all", F.expr(f"array_sort(concat(base, coalesce(added, cast(array() as {_SPANS}))))"))


def general(kind: int, found: str) -> str:
    """What stands in place of a span."""
    if kind < KINDS.index("term"):
        return f"[{KINDS[kind].upper()}]"
    return "[NAME]" if found[:1].isupper() else ""


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with a general term for each (start, kind, end); overlapping spans go together."""
    out, done = [], 0
    for start, kind, end in spans:
        if end <= done:
            continue
        if start >= done:
            out += [text[done:start], general(kind, text[start:end])]
        done = end
    return "".join([*out, text[done:]])


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            if spans and texts[k]:
                texts[k] = replaced(texts[k], [(s["start"], s["kind"], s["end"]) for s in spans])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "clean"])


def sanitised(documents: DataFrame, spark: SparkSession, **options) -> DataFrame:
    """``documents`` with general terms in place of entities and of words that reveal them."""
    docs = packed(documents, spark)
    found = scanned(docs.select("nr", "doc.doc_id", "doc.text"), spark, F.col("nr"), **options)
    spans = found.where(F.size("all") > 0).select(F.col("row_key").alias("nr"), F.col("all").alias("spans"))
    marked = docs.join(spans, "nr", "left").select("doc", "doc.text", "spans")
    clean = marked.mapInArrow(_sanitise, docs.select("doc", F.lit(None).cast("string").alias("clean")).schema)
    return clean.select(F.col("doc").withField("text", F.col("clean")).alias("doc")).select("doc.*")


_JOIN = "concat_ws(',', transform({}, s -> concat(element_at(array('email','ip','card','phone','term'), s.kind + 1), ':', s.start, ':', s.end)))"


def op10_pii_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every row of ``documents``."""
    found = scanned(read_table(spark, sf_dir, "documents"), spark)
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])),
        F.sha2(F.expr(_JOIN.format("base")), 256).alias("base_sha256"),
        F.expr(_JOIN.format("`all`")).alias("spans"),
    )
