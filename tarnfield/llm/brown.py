"""Operator 11, scores of texts under a class-based bigram model with Brown's classes.

Tokens are words, A-Z in lower case, and one end for each text, which is also what
stands before its first word. All words of the training texts are counted. The HOT most
frequent ones are units by themselves; the others are units in TAILS groups, by their
last letters and length, so that every word of any corpus belongs to a unit and what
tasks must hold is bounded. Bigrams of units are counted over all training texts.

Exchange clustering puts the units in CLASSES classes so that the mutual information of
neighbouring classes is as high as moves of single units can make it. A round works
on Spark: with the counts of classes beside each unit, a task weighs the move of each
of its units to every class, against the table of class bigrams. Half of the units,
drawn anew each round, may move at once; moves made together may harm each other, so
a round that loses information is undone and tried with a quarter, and so on. The end
is a class of its own.

A token then has the probability P(class | class before) P(unit | class) P(word | unit):
Witten-Bell smoothing with the classes' own shares for the first, one added to each
count for the second, and for a word of a group one added to each word's count and one
for all words not seen. Words of groups get their counts by a join.

Defined results: a null or empty text has the end alone; rows with null id are trained
on; repeated rows and ids come back row by row; without training texts all counts are 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.bpe import ragged
from tarnfield.llm.common import mix, slices, span_hashes, stored, utf8, words
from tarnfield.sources import read_table

HOT, TAILS, CLASSES = 8192, 512, 64
#: A longer word is in a group however frequent it is, so the table of words has a bound.
LONGEST = 100
ROUNDS, ENOUGH = 10, 1e-3
#: Bytes of text counted together.
SLICE = 4_000_000

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


class Tokens:
    """The words of some texts: their hashes, where they lie, and the first of each text."""

    def __init__(self, text: pa.Array):
        data, offsets = utf8(text)
        self.data = _SMALL[data]
        self.start, self.end, self.rows = words(self.data, offsets)
        self.hashes = span_hashes(self.data, self.start, self.end)

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at some places."""
        size = self.end[at] - self.start[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = self.data[ragged(self.start[at], size)]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())

    def groups(self) -> np.ndarray:
        """The group of each word, by its last three bytes and its length in steps."""
        size = self.end - self.start
        key = np.minimum(size, 15).astype(np.uint64) // np.uint64(3)
        for k in (1, 2, 3):
            last = np.where(size >= k, self.data[np.maximum(self.end - k, 0)] if len(self.end) else 0, 0)
            key = key << np.uint64(8) | last.astype(np.uint64)
        return (mix(key) % np.uint64(TAILS)).astype(np.int64)


@dataclass
class Units:
    """Frequent words by hash, in order; unit 0 is the end, the groups come last."""

    hashes: np.ndarray
    number: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order = np.argsort(self.hashes)
        self.hashes, self.number = self.hashes[order], order + 1
        self.hot = len(order)
        self.size = 1 + self.hot + TAILS

    def of(self, tokens: Tokens) -> np.ndarray:
        out = 1 + self.hot + tokens.groups()
        if self.hot:
            at = np.minimum(np.searchsorted(self.hashes, tokens.hashes), self.hot - 1)
            out = np.where(self.hashes[at] == tokens.hashes, self.number[at], out)
        return out


def _with_ends(units: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text with the end appended, and what stands before each."""
    now = np.insert(units, rows[1:], 0)
    before = np.concatenate([[0], now[:-1]])
    return now, before


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word comes in a slice of texts."""
    for whole in batches:
        for batch in slices(whole, 0, SLICE):
            tokens = Tokens(batch.column(0))
            _, first, n = np.unique(tokens.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([tokens.strings(first), pa.array(n.astype(np.int64))], ["word", "n"])


def _pairs(units: Units):
    """A task that counts the bigrams of units in slices of texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, SLICE):
                tokens = Tokens(batch.column(0))
                now, before = _with_ends(units.of(tokens), tokens.rows)
                codes, n = np.unique(before * units.size + now, return_counts=True)
                columns = [(codes // units.size).astype(np.int32), (codes % units.size).astype(np.int32), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n"])

    return task


def _of_group(units: Units):
    """A task that gives the number of distinct words of each group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(units.size, np.int64)
        for batch in batches:
            tokens = Tokens(batch.column(0))
            sums += np.bincount(units.of(tokens), minlength=units.size)
        unit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int32)), pa.array(sums[unit])], ["unit", "n"])

    return task


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def information(table: np.ndarray) -> float:
    """What exchange raises: mutual information of neighbouring classes, in counts."""
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum())


def gains(table: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """What the move of each unit from its class ``own`` to every class adds to the information.

    ``table`` counts class bigrams; ``left[u, c]`` and ``right[u, c]`` how often class c stands
    before and after the unit, itself left out, and ``alone[u]`` how often it follows itself.
    """
    n, k = left.shape
    row, every = np.arange(n), np.arange(k)
    rest = np.repeat(table[None].astype(np.float64), n, 0)  # without the unit
    rest[row, own] -= right
    rest[row, :, own] -= left
    rest[row, own, own] -= alone
    first, second = right.sum(1) + alone, left.sum(1) + alone
    here, there = (np.repeat(table.sum(k)[None].astype(np.float64), n, 0) for k in (1, 0))  # as first and as second of a bigram
    here[row, own] -= first
    there[row, own] -= second
    with_right = xlogx(rest + right[:, None, :]) - xlogx(rest)  # the unit joins class h: row h, then column h
    with_left = xlogx(rest + left[:, :, None]) - xlogx(rest)
    corner = rest[:, every, every]
    out = with_right.sum(2) - with_right[:, every, every] + with_left.sum(1) - with_left[:, every, every]
    out += xlogx(corner + left + right + alone[:, None]) - xlogx(corner)
    out -= xlogx(here + first[:, None]) - xlogx(here)
    out -= xlogx(there + second[:, None]) - xlogx(there)
    return out - out[row, own][:, None]


#: Bigrams in a block, about.
BLOCK = 1 << 18
BLOCKS = "unit binary, other binary, n binary, after binary"
_TYPES = {"unit": "<i4", "other": "<i4", "n": "<i8", "after": "?"}


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams sorted by unit, in blocks of arrays that hold units whole: rounds read them many times."""

    def block(parts: list[dict[str, np.ndarray]], rows: slice) -> pa.RecordBatch:
        data = [np.concatenate([p[c] for p in parts])[rows].astype(t).tobytes() for c, t in _TYPES.items()]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], list(_TYPES))

    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in _TYPES})
        if sum(len(p["unit"]) for p in held) >= BLOCK:
            unit = np.concatenate([p["unit"] for p in held])
            cut = int(np.searchsorted(unit, unit[-1]))
            if cut:
                yield block(held, slice(0, cut))
                held = [{c: np.concatenate([p[c] for p in held])[cut:] for c in _TYPES}]
    if sum(len(p["unit"]) for p in held):
        yield block(held, slice(None))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Units, what stands beside them, counts, and whether it is after the unit, of every block."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield [np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in _TYPES.items()]


def _sums(size: int):
    """A task that counts units."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for unit, _, n, after in _arrays(batches):
            np.add.at(sums, unit[~after], n[~after])
        unit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int32)), pa.array(sums[unit])], ["unit", "n"])

    return task


def _table(classes: np.ndarray, many: int):
    """A task that counts class bigrams over its bigrams of units."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(many * many)
        for a, b, n, after in _arrays(batches):
            sums += np.bincount((classes[a] * many + classes[b])[after], n[after], many * many)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(sums[cell].astype(np.int64))], ["cell", "n"])

    return task


def _moves(classes: np.ndarray, table: np.ndarray, may: np.ndarray):
    """A task that gives the best class of each of its units that may move, where that gains."""
    many, size = len(table), len(classes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside, alone = np.zeros((2, size * many)), np.zeros(size)
        for unit, other, n, after in _arrays(batches):
            same = unit == other
            alone += np.bincount(unit[same & after], n[same & after], size)
            for side in (0, 1):
                pick = np.flatnonzero((after == bool(side)) & ~same & may[unit])
                beside[side] += np.bincount(unit[pick] * np.int64(many) + classes[other[pick]], n[pick], size * many)
        left, right = (x.reshape(size, many) for x in beside)
        units = np.flatnonzero(left.any(1) | right.any(1))
        to = np.empty(len(units), np.int64)
        gain = np.empty(len(units))
        for a in range(0, len(units), 64):
            part = units[a : a + 64]
            each = gains(table, classes[part], left[part], right[part], alone[part])
            each[:, 0] = -np.inf  # the end's
            to[a : a + 64], gain[a : a + 64] = each.argmax(1), each.max(1)
        good = gain > 1e-6
        yield pa.RecordBatch.from_arrays([pa.array(units[good].astype(np.int32)), pa.array(to[good].astype(np.int32))], ["unit", "to"])

    return task


def exchanged(beside: DataFrame, counts: np.ndarray, many: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of every unit, the table of class bigrams, and the information after each round.

    ``beside`` holds every bigram twice, in blocks, for both of its units. What comes to
    the driver is bounded by the number of units and of classes.
    """
    size = len(counts)
    classes = np.zeros(size, np.int64)
    order = np.argsort(-counts[1:], kind="stable") + 1
    classes[order] = 1 + np.arange(size - 1) % (many - 1)

    def counted(now: np.ndarray) -> np.ndarray:
        out = np.zeros(many * many, np.int64)
        for r in beside.mapInArrow(_table(now, many), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r.cell] = r.n
        return out.reshape(many, many)

    table = counted(classes)
    told, part, still = [information(table)], 2, 0
    for turn in range(rounds):
        drawn = mix(np.arange(size, dtype=np.uint64) * np.uint64(64) + np.uint64(turn)) % np.uint64(part)
        may = (drawn == 0) & (np.arange(size) > 0)
        moves = beside.mapInArrow(_moves(classes, table, may), "unit int, to int").collect()
        after = classes.copy()
        after[[r.unit for r in moves]] = [r.to for r in moves]
        fresh = counted(after) if moves else table
        now = information(fresh)
        if moves and now <= told[-1]:
            part *= 2
            continue
        # what independent classes would have is the least that information can be
        known = abs(now + xlogx(fresh.sum(keepdims=True)).item())
        still = still + 1 if now - told[-1] < ENOUGH * known else 0
        if moves:
            classes, table = after, fresh
            told.append(now)
        if still == 3:
            break
    return classes, table, told


class Model:
    """Logarithms of the probabilities: a few megabytes, whatever the corpus."""

    def __init__(self, units: Units, classes: np.ndarray, table: np.ndarray, counts: np.ndarray, distinct: np.ndarray, tokens: int, vocabulary: int):
        self.units, self.classes, self.counts = units, classes, counts
        self.tokens, self.vocabulary = tokens, vocabulary
        many = len(table)
        table = table.astype(np.float64)
        share = (table.sum(0) + 1) / (table.sum() + many)
        kinds = np.maximum(1, (table > 0).sum(1))[:, None]
        self.step = np.log10((table + kinds * share) / (table.sum(1)[:, None] + kinds))
        inside = np.bincount(classes, minlength=many)
        of_class = np.bincount(classes, counts, many)
        self.emit = np.log10((counts + 1) / (of_class + inside)[classes])
        # a word of a group: the count of the word, which comes by the join, is over this
        group = np.arange(units.size) > units.hot
        self.emit = self.emit - np.where(group, np.log10(counts + distinct + 1), 0)
        # the count of a frequent word or the end, in the base score
        self.base = np.where(group, 0, np.log10(counts + 1))
        self.over = float(np.log10(tokens + vocabulary + 1))


SCORED = (
    "nr bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double,"
    " rest array<struct<word:string,times:bigint>>"
)


def _scored(model: Model):
    """A task that scores texts, but for the counts of the words of groups, which it lists."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = model.units
        for whole in batches:
            for batch in slices(whole, 3, SLICE):
                tokens = Tokens(batch.column(3))
                own = units.of(tokens)
                now, before = _with_ends(own, tokens.rows)
                bounds = tokens.rows + np.arange(len(tokens.rows))
                n = np.diff(bounds)
                sums = lambda x: np.add.reduceat(x, bounds[:-1]) if len(n) else np.zeros(0)
                score = sums(model.step[model.classes[before], model.classes[now]] + model.emit[now])
                base = sums(model.base[now])
                known = sums(((now <= units.hot) & (model.counts[now] > 0)).astype(np.int64))
                rest = np.flatnonzero(own > units.hot)
                row = np.repeat(np.arange(len(n)), np.diff(tokens.rows))[rest]
                _, hashed = np.unique(tokens.hashes[rest], return_inverse=True)
                codes, first, times = np.unique(row * np.int64(len(rest) + 1) + hashed, return_index=True, return_counts=True)
                cuts = pa.array(np.searchsorted(codes, np.arange(len(n) + 1) * np.int64(len(rest) + 1)).astype(np.int32))
                listed = pa.StructArray.from_arrays([tokens.strings(rest[first]), pa.array(times.astype(np.int64))], ["word", "times"])
                columns = [*batch.columns[:3], pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(cuts, listed)]
                yield pa.RecordBatch.from_arrays(columns, ["nr", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"])

    return task


def counted(training: DataFrame, spark: SparkSession) -> DataFrame:
    """``word, n`` of every word of ``training(text)``; stored."""
    return stored(training.select("text").mapInArrow(_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), spark)


def trained(training: DataFrame, counts: DataFrame, spark: SparkSession, hot: int = HOT, many: int = CLASSES) -> Model:
    """Learn from all of ``training(text)``, whose words ``counts`` holds."""
    texts = training.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    table = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(hot).collect()
    units = Units(Tokens(pa.array([r.word for r in table], pa.string())).hashes)
    pairs = training.select("text").mapInArrow(_pairs(units), "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = stored(pairs, spark)
    ahead = pairs.select(F.col("a").alias("unit"), F.col("b").alias("other"), "n", F.lit(True).alias("after"))
    behind = pairs.select(F.col("b").alias("unit"), F.col("a").alias("other"), "n", F.lit(False).alias("after"))
    beside = stored(ahead.union(behind).repartition("unit").sortWithinPartitions("unit").mapInArrow(_in_blocks, BLOCKS), spark)
    sums = np.zeros(units.size, np.int64)
    for r in beside.mapInArrow(_sums(units.size), "unit int, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).collect():
        sums[r.unit] = r.n
    of_group = np.zeros(units.size, np.int64)
    for r in counts.select("word").mapInArrow(_of_group(units), "unit int, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).collect():
        of_group[r.unit] = r.n
    classes, joint, _ = exchanged(beside, sums, many)
    return Model(units, classes, joint, sums, of_group, total + texts, distinct + (texts > 0))


def scored(documents: DataFrame, counts: DataFrame, model: Model, spark: SparkSession) -> DataFrame:
    """Scores of every row of ``documents(doc_id, held_out, text)`` under the base and the class model."""
    rows = documents.select(F.monotonically_increasing_id().alias("nr"), F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "text")
    local = stored(rows.mapInArrow(_scored(model), SCORED), spark)
    # a word outside the table is at most one in HOT of all training words, so no key is hot
    each = local.select("nr", F.explode("rest").alias("r")).select("nr", "r.word", "r.times").join(counts, "word")
    rest = each.groupBy("nr").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    out = local.drop("rest").join(rest, "nr", "left").withColumn("score", F.col("score") + logs)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(model.over)).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op11_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents``; a seventh by ``doc_id`` is not learned from."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    documents = documents.withColumn("held_out", held_out)
    training = documents.where(~F.col("held_out"))
    counts = counted(training, spark)
    return scored(documents, counts, trained(training, counts, spark), spark)
