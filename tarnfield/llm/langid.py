"""Operator 9, language of texts, span by span, by Viterbi over per-word scores.

Training counts the letter groups (one to four letters, word ends marked, hashed to
BUCKETS) and the scripts of words for each language, over a seeded sample of about
SAMPLE labelled documents a language. A word's score for a language is the sum of
the log probabilities of its groups, divided by the number of groups that overlap
a letter. The script of a word narrows its candidates: a language competes only
where at least SCRIPT_SHARE of its training words have that script. In a script that
none has, all compete, by their share of the training words alone, which is so weak that
the words beside decide where there are any.

In a text, the best sequence of languages is found over its words with a penalty for
each switch; runs of equal language are the spans. The text's language is the one
with most letters in it, and the score its share of the letters.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is
every text when nothing is learned; a document with null language is not learned
from; ties go to the language first in order; repeated rows and
null ids come back row by row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.bpe import ragged
from tarnfield.llm.common import bound_batches, slices, span_hashes, worker_state
from tarnfield.sources import read_table

#: Labelled documents a language to learn from, about; all if there are fewer.
SAMPLE = 3000
BUCKETS = 1 << 16
#: Bytes of text labelled together: the longest text sets the number of steps.
SLICE = 4_000_000
SCRIPT_SHARE = 0.02
#: Log probability that a switch costs, and how much one word may say at most.
SWITCH, MOST = 6.0, 8.0

# First and last code point of the main ranges of scripts.
SCRIPTS = (
    ("Latin", 0x41, 0x24F),
    ("Greek", 0x370, 0x3FF),
    ("Cyrillic", 0x400, 0x52F),
    ("Armenian", 0x530, 0x58F),
    ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x77F),
    ("Devanagari", 0x900, 0x97F),
    ("Bengali", 0x980, 0x9FF),
    ("Gurmukhi", 0xA00, 0xA7F),
    ("Gujarati", 0xA80, 0xAFF),
    ("Tamil", 0xB80, 0xBFF),
    ("Telugu", 0xC00, 0xC7F),
    ("Kannada", 0xC80, 0xCFF),
    ("Malayalam", 0xD00, 0xD7F),
    ("Thai", 0xE00, 0xE7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF),
    ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
    ("Han", 0x20000, 0x323AF),
)
"""Other letters share one script more, the last."""
NAMES = sorted({s[0] for s in SCRIPTS})
OTHER = len(NAMES)

def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: 1 a letter, 2 a mark, 0 neither; its lower case; its script."""
    state = worker_state()
    if "letters" not in state:
        n = 0x110000
        kind, lower, script = np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32), np.full(n, OTHER, np.uint8)
        for point in range(n):
            c = chr(point)
            category = unicodedata.category(c)[0]
            if category in "LM":
                kind[point] = 1 if category == "L" else 2
                small = c.lower()
                lower[point] = ord(small) if len(small) == 1 else point
        for name, low, high in SCRIPTS:
            script[low : high + 1] = NAMES.index(name)
        state["letters"] = kind, lower, script
    return state["letters"]


class Words:
    """The distinct words of some texts, and where in them each word stands.

    A word is a run of letters and marks with a letter; it is compared in lower case.
    """

    def __init__(self, texts: list[str | None]):
        kind, lower, script = letters()
        points = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le"), "<u4")
        kinds = kind[points]
        ink = np.concatenate([[False], kinds > 0, [False]])
        start, end = np.flatnonzero(ink[1:] & ~ink[:-1]), np.flatnonzero(~ink[1:] & ink[:-1])
        if (kinds == 2).any():
            sums = np.concatenate([[0], np.cumsum(kinds == 1)])
            real = sums[end] > sums[start]
            start, end = start[real], end[real]
        small = lower[points]
        first = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
        self.bounds = np.searchsorted(start, first)
        text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.start, self.end = start - first[text], end - first[text]
        name = span_hashes(small.view(np.uint8), 4 * start, 4 * end)
        self.name, one, self.word = np.unique(name, return_index=True, return_inverse=True)
        self.script = script[small[start[one]]] if len(one) else np.zeros(0, np.uint8)
        # the distinct words in a row, each between two marks
        size = end[one] - start[one]
        self.first = np.cumsum(size + 2) - size - 2
        self.letters = np.zeros(int((size + 2).sum()), np.uint32)
        self.letters[self.first] = 2
        self.letters[self.first + size + 1] = 3
        self.letters[ragged(self.first + 1, size)] = small[ragged(start[one], size)]
        self.left = np.repeat(self.first + size + 2, size + 2) - np.arange(len(self.letters))

    def text(self, k: int) -> str:
        """The distinct word ``k``."""
        end = self.first[k + 1] if k + 1 < len(self.first) else len(self.letters)
        return self.letters[self.first[k] + 1 : end - 1].tobytes().decode("utf-32-le")

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size of letter group, its buckets and where they begin in ``letters``."""
        value = np.zeros(len(self.letters), np.uint32)
        for size in (1, 2, 3, 4):
            at = np.flatnonzero(self.left >= size)
            value[at] = (value[at] + np.uint32(size)) * np.uint32(1_000_003) + self.letters[at + size - 1]
            mixed = (value[at] ^ value[at] >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            yield (mixed >> np.uint32(8)) & np.uint32(BUCKETS - 1), at


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets, and of scripts behind them, by language."""
    for whole in batches:
        for batch in slices(whole, 1):
            held: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text)
            for lang, texts in held.items():
                words = Words(texts)
                times = np.bincount(words.word, minlength=len(words.first))
                sums = np.zeros(BUCKETS + OTHER + 1, np.int64)
                sums[BUCKETS:] = np.bincount(words.script, times, OTHER + 1)
                of = np.searchsorted(words.first, np.arange(len(words.letters)), "right") - 1
                for bucket, at in words.groups():
                    sums[:BUCKETS] += np.bincount(bucket, times[of[at]], BUCKETS).astype(np.int64)
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])], ["lang", "bucket", "n"])


class Model:
    """Scores of words by language; a few megabytes, whatever the corpus."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        groups, scripts = counts[:, :BUCKETS].astype(np.float64), counts[:, BUCKETS:]
        self.log = np.log((groups + 0.1) / (groups.sum(1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32).T.copy()
        self.allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
        self.foreign = ~self.allowed.any(0)
        self.share = np.log((scripts.sum(1) + 1) / (scripts.sum() + len(langs))).astype(np.float32)

    def scores(self, words: Words) -> np.ndarray:
        """Log probabilities of each language for each distinct word, best 0."""
        total = np.zeros((len(words.first), len(self.langs)), np.float32)
        for bucket, at in words.groups():
            part = np.zeros((len(words.letters), len(self.langs)), np.float32)
            part[at] = self.log[bucket]
            if len(words.first):
                total += np.add.reduceat(part, words.first, 0)
        total = np.where(self.allowed.T[words.script], total / 2.5, -np.inf)  # a letter is in about 2.5 groups
        total = np.where(self.foreign[words.script][:, None], self.share, total)
        return np.maximum(total - total.max(1, keepdims=True, initial=-np.inf), -MOST)


def trained(documents: DataFrame, spark: SparkSession, sample: int = SAMPLE) -> Model:
    """Learn from ``documents(doc_id, text, lang)`` with a language.

    The sample takes each language's documents below a hash limit set by their
    number, so the driver receives at most a table of buckets for each language.
    """
    bound_batches(spark)
    labelled = documents.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text", F.lit(9)).alias("draw"))
    many = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share = {r.lang: min(1.0, sample / r.n) for r in many}
    limit = F.lit(0.0)
    for lang, part in share.items():
        limit = F.when(F.col("lang") == lang, F.lit(part)).otherwise(limit)
    drawn = labelled.where(F.pmod("draw", F.lit(1 << 20)) < limit * (1 << 20)).select("lang", "text")
    rows = drawn.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted(share)
    counts = np.zeros((len(langs), BUCKETS + OTHER + 1), np.int64)
    for r in rows:
        counts[langs.index(r.lang), r.bucket] = r.n
    return Model(langs, counts)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; words of text k are ``bounds[k]:bounds[k + 1]``.

    All texts go on together, longest first, one word at a step.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], bounds[:-1][order]
    n_langs = scores.shape[1]
    came = np.zeros(scores.shape, np.int16)
    own = np.arange(n_langs, dtype=np.int16)
    value = np.zeros((len(order), n_langs), np.float32)
    out = np.zeros(len(scores), np.int16)
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    for step, n in enumerate(live):
        at = starts[:n] + step
        here = value[:n]
        if step:
            best = here.argmax(1)
            jump = here[np.arange(n), best] - switch
            came[at] = np.where(here >= jump[:, None], own, best[:, None])
            here = np.maximum(here, jump[:, None])
        value[:n] = here + scores[at]
    state = np.zeros(len(order), np.int16)
    for step in range(len(live) - 1, -1, -1):
        n = live[step]
        fresh = live[step + 1] if step + 1 < len(live) else 0
        state[fresh:n] = value[fresh:n].argmax(1)
        at = starts[:n] + step
        out[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return out


def _judged(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[str]]:
    """Language, score and spans of each text."""
    n = len(texts)
    if not model.langs:
        return ["und"] * n, [0.0] * n, [""] * n
    words = Words(texts)
    scores = model.scores(words)
    bounds, start, end = words.bounds, words.start, words.end
    path = viterbi(scores[words.word], bounds)
    votes = np.zeros((n, len(model.langs)))
    np.add.at(votes, (np.repeat(np.arange(n), np.diff(bounds)), path), end - start)
    best, total = votes.argmax(1), votes.sum(1)
    change = np.ones(len(path) + 1, bool)
    change[1:-1] = path[1:] != path[:-1]
    change[bounds] = True
    cuts = np.flatnonzero(change)
    at = np.searchsorted(cuts, bounds).tolist()
    name = [model.langs[k] for k in path[cuts[:-1]]]
    low, high = start[cuts[:-1]].tolist(), end[cuts[1:] - 1].tolist() if len(path) else []
    spans = [",".join(f"{name[x]}:{low[x]}:{high[x]}" for x in range(a, b)) for a, b in zip(at, at[1:])]
    langs = [model.langs[k] if t else "und" for k, t in zip(best, total)]
    return langs, [float(v[k] / t) if t else 0.0 for v, k, t in zip(votes, best, total)], spans


def labelled(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` and the columns to keep, of ``documents(doc_id, text)``.

    ``spans`` lists ``language:start:end`` in code points, joined by commas.
    """
    keep = keep or []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                langs, shares, spans = _judged(batch.column(1).to_pylist(), model)
                columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, pa.string()), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans", *keep])

    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *keep)
    kept = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(task, "doc_id bigint, lang_pred string, score double, spans string" + kept)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every row of ``documents``; a quarter by ``doc_id`` is not learned from."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    documents = documents.withColumn("held_out", held_out)
    model = trained(documents.where(~F.col("held_out")), spark)
    return labelled(documents, model, ["held_out"]).select("doc_id", "held_out", "lang_pred", "score", "spans")
