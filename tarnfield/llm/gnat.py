"""Operator 12, hard negatives by a tree of hyperplane cells with distance ranges.

Vectors become whole numbers, ``floor(scale * x)``, and score by inner product. One
coordinate more, ``sqrt(longest - norm)``, gives all the same length, and an anchor
gets 0 there, so that a score is a distance: ``d^2 = |a|^2 + longest - 2 score``. A
window of scores is then an annulus about the anchor.

The tree's root is on Spark: ROOTS split points, chosen far apart from a sample of
SAMPLE vectors, deal all vectors to the nearest of them. Each split point keeps the
range of its distances to the vectors of every cell. A cell is stored in chunks of
about ``chunk`` vectors, dealt by a hash of the id, and every chunk holds a tree of its
own with FAN split points a node, the same ranges, and leaves of up to LEAF vectors.

A search passes over a sibling when some split point's range shows that it cannot
meet the annulus; leaves are compared exactly, in whole numbers. The annulus shrinks
as good vectors are found. Anchors look in their own cell first, then in the others
that the scores found there leave open. The positives found give the windows of the
search for negatives.

Defined results: rows with null label, vector or id, or with a null or non-finite
component take no part; vectors of different lengths are never compared; rows of one
id count as one, the least by label and components; a label of any number and a zero
vector are as good as others; an anchor without positives, or a positive whose window
holds nothing, as one of negative score, gives no rows; an empty table gives an empty
result; other columns are ignored. Scores that 64 bits cannot hold raise an error.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import groups, stored
from tarnfield.sources import read_table

SCALE = 256
#: Vectors that the root's split points are chosen from, and their number.
SAMPLE, ROOTS = 4096, 64
FAN, LEAF, CHUNK = 16, 128, 8192
#: Anchors searched in one copy of a chunk, and at once.
LANE_ANCHORS, BATCH = 65_536, 512
#: What rounding may do to a distance, as a share of the longest one.
SLACK = 1e-7
LOWEST = np.iinfo(np.int64).min


def _spread(rows: np.ndarray, heights: np.ndarray, most: int) -> np.ndarray:
    """Places of up to ``most`` distinct rows, each the farthest from those before it."""
    picked, far = [0], _apart(rows, heights, rows[:1], heights[:1])[:, 0]
    while len(picked) < min(most, len(rows)):
        at = int(far.argmax())
        if far[at] <= 0:
            break
        picked.append(at)
        far = np.minimum(far, _apart(rows, heights, rows[at : at + 1], heights[at : at + 1])[:, 0])
    return np.array(picked)


def _apart(a: np.ndarray, a_height: np.ndarray, b: np.ndarray, b_height: np.ndarray) -> np.ndarray:
    """Distances between two sets of vectors with their last coordinate."""
    norms = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] + (a_height[:, None] - b_height[None, :]) ** 2
    return np.sqrt(np.maximum(norms - 2 * (a @ b.T), 0))


def _open(to_splits: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray, slack: float) -> np.ndarray:
    """Which siblings may meet the annulus ``near..far`` of each row.

    ``low[i, j]`` and ``high[i, j]`` are the range of split point i over sibling j.
    """
    least = np.maximum(to_splits[:, :, None] - high[None], low[None] - to_splits[:, :, None]).max(1)
    most = (to_splits[:, :, None] + high[None]).min(1)
    return (least <= far[:, None] + slack) & (most >= near[:, None] - slack)


class Tree:
    """A chunk of vectors in nodes of FAN split points."""

    def __init__(self, names: np.ndarray, labels: np.ndarray, whole: np.ndarray, longest: float):
        self.names, self.labels, self.whole, self.longest = names, labels, whole, longest
        rows = whole.astype(np.float64)
        heights = np.sqrt(np.maximum(longest - (rows * rows).sum(1), 0))
        # sums of products below 2^53 are exact in doubles, and much faster there
        self.fits = float(np.abs(rows).max(initial=0)) ** 2 * max(1, rows.shape[1]) < 2**52
        self.nodes: list[tuple] = []
        self._split(np.arange(len(names)), rows, heights)

    def _split(self, members: np.ndarray, rows: np.ndarray, heights: np.ndarray) -> int:
        """Add the node of some members and all below it; gives its number."""
        number = len(self.nodes)
        self.nodes.append(("leaf", members))
        if len(members) > LEAF:
            some = members[:: max(1, len(members) // (4 * FAN))]
            splits = some[_spread(rows[some], heights[some], FAN)]
            if len(splits) > 1:
                apart = _apart(rows[members], heights[members], rows[splits], heights[splits])
                own = apart.argmin(1)
                parts = [np.flatnonzero(own == j) for j in range(len(splits))]
                kept = [j for j, p in enumerate(parts) if len(p)]
                low = np.stack([apart[parts[j]].min(0) for j in kept], 1)
                high = np.stack([apart[parts[j]].max(0) for j in kept], 1)
                if len(kept) > 1:
                    below = [self._split(members[parts[j]], rows, heights) for j in kept]
                    self.nodes[number] = ("node", splits, low, high, below)
        return number

    def _scores(self, queries: np.ndarray, members: np.ndarray) -> np.ndarray:
        if self.fits:
            return (queries.astype(np.float64) @ self.whole[members].astype(np.float64).T).astype(np.int64)
        return queries @ self.whole[members].T

    def search(self, queries: np.ndarray, names: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best ``most`` vectors in each window, LOWEST where there are fewer.

        Window k is about query ``of[k]`` and holds scores from ``low[k]`` to ``high[k]``,
        of the same label as the query but not itself, or of another label.
        """
        best = np.full((len(of), most), LOWEST), np.full((len(of), most), np.iinfo(np.int64).max)
        if not len(of):
            return best
        norm = (queries.astype(np.float64) ** 2).sum(1) + self.longest
        slack = SLACK * float(np.sqrt(norm.max() + self.longest)) + 1e-6
        floor = low.copy()  # what a score must reach, as far as is known
        distance = lambda rows, score: np.sqrt(np.maximum(norm[of[rows]] - 2 * score.astype(np.float64), 0))

        def leaf(members: np.ndarray, rows: np.ndarray) -> None:
            scores = self._scores(queries[of[rows]], members)
            alike = self.labels[members][None, :] == labels[of[rows]][:, None]
            fit = (scores >= floor[rows][:, None]) & (scores <= high[rows][:, None]) & (alike == same)
            if same:
                fit &= self.names[members][None, :] != names[of[rows]][:, None]
            some = np.flatnonzero(fit.any(1))
            if not len(some):
                return
            rows = rows[some]
            scores = np.concatenate([best[0][rows], np.where(fit, scores, LOWEST)[some]], 1)
            ids = np.where(fit[some], self.names[members][None, :], np.iinfo(np.int64).max)
            ids = np.concatenate([best[1][rows], ids], 1)
            order = np.lexsort((ids, -np.maximum(scores, LOWEST + 1)), axis=-1)[:, :most]
            best[0][rows], best[1][rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
            floor[rows] = np.maximum(low[rows], best[0][rows, -1])

        def visit(number: int, rows: np.ndarray, done: np.ndarray | None) -> None:
            node = self.nodes[number]
            if node[0] == "leaf":
                leaf(node[1], rows if done is None else rows[done[rows] != number])
                return
            _, splits, lows, highs, below = node
            asked, back = np.unique(of[rows], return_inverse=True)
            to = np.sqrt(np.maximum(norm[asked][:, None] - 2 * self._scores(queries[asked], splits).astype(np.float64), 0))[back]
            near = distance(rows, high[rows])
            for j in np.argsort(lows.min(0)).tolist():
                open_ = _open(to, lows[:, j : j + 1], highs[:, j : j + 1], near, distance(rows, floor[rows]), slack)[:, 0]
                if open_.any():
                    visit(below[j], rows[open_], done)

        # once straight down to the leaf of the nearest split points, for a first idea of the scores
        first = None
        if same and self.nodes[0][0] == "node":
            first = np.zeros(len(of), np.int64)
            ways = {0: np.arange(len(of))}
            while ways:
                number, rows = ways.popitem()
                node = self.nodes[number]
                if node[0] == "leaf":
                    first[rows] = number
                    leaf(node[1], rows)
                    continue
                _, splits, lows, _, below = node
                nearest = self._scores(queries[of[rows]], splits).argmax(1)
                own = lows[nearest].argmin(1)  # a split point's own cell is the one that comes nearest to it
                for j in np.unique(own).tolist():
                    ways[below[j]] = rows[own == j]
        visit(0, np.arange(len(of)), first)
        return best


class Root:
    """The split points of the whole table, and their ranges over the cells."""

    def __init__(self, splits: np.ndarray, longest: float):
        self.longest = longest
        self.splits = splits.astype(np.float64)
        self.heights = np.sqrt(np.maximum(longest - (self.splits * self.splits).sum(1), 0))
        self.low = np.full((len(splits), len(splits)), np.inf)
        self.high = np.full((len(splits), len(splits)), -np.inf)

    def to_data(self, whole: np.ndarray) -> np.ndarray:
        rows = whole.astype(np.float64)
        return _apart(rows, np.sqrt(np.maximum(self.longest - (rows * rows).sum(1), 0)), self.splits, self.heights)

    def cells_of(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Cells that may hold a score of the anchor from ``low`` to ``high``, as flags."""
        rows = anchors.astype(np.float64)
        norm = (rows * rows).sum(1) + self.longest
        to = _apart(rows, np.zeros(len(rows)), self.splits, self.heights)
        distance = lambda s: np.sqrt(np.maximum(norm - 2 * s.astype(np.float64), 0))
        slack = SLACK * float(np.sqrt(norm.max(initial=0) + self.longest)) + 1e-6
        cells = np.zeros(to.shape, bool)
        for a in range(0, len(rows), BATCH):
            part = slice(a, a + BATCH)
            cells[part] = _open(to[part], self.low, self.high, distance(high)[part], distance(low)[part], slack)
        return cells


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _by_dim(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row places and matrix of the vectors of each length in a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, _matrix(batch.column(column).take(pa.array(rows)), len(rows)) if dim else np.zeros((len(rows), 0), np.int64)


def _dealt(roots: dict[int, Root]):
    """A task that gives the cell of each vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for dim, rows, whole in _by_dim(batch, "whole"):
                if dim in roots:
                    cell[rows] = roots[dim].to_data(whole).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return task


def _ranges(roots: dict[int, Root]):
    """A task that gives the range of its vectors of each cell to every split point."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for dim, rows, whole in _by_dim(batch, "whole"):
                if dim not in roots:
                    continue
                apart = roots[dim].to_data(whole)
                for cell in np.unique(cells[rows]).tolist():
                    part = apart[cells[rows] == cell]
                    low, high = part.min(0), part.max(0)
                    was = seen.get((dim, cell), (low, high))
                    seen[dim, cell] = [np.minimum(low, was[0]), np.maximum(high, was[1])]
        out = [(dim, cell, k, float(lo), float(hi)) for (dim, cell), (low, high) in seen.items() for k, (lo, hi) in enumerate(zip(low, high))]
        columns = list(zip(*out)) if out else [[]] * 5
        types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["dim", "cell", "split", "low", "high"])

    return task


def _grown(longest: float):
    """A task over vectors sorted by chunk: one row for each chunk, its tree."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["dim", "cell", "chunk"]):
            n = group.num_rows
            whole = _matrix(group.column("whole").combine_chunks(), n) if group.column("dim")[0].as_py() else np.zeros((n, 0), np.int64)
            tree = Tree(group.column("vec_id").to_numpy(), group.column("label").to_numpy(), whole, longest)
            head = [group.column(c)[:1].combine_chunks() for c in ("dim", "cell", "chunk")]
            yield pa.RecordBatch.from_arrays([*head, pa.array([pickle.dumps(tree.__dict__, protocol=5)], pa.binary())], ["dim", "cell", "chunk", "tree"])

    return task


def _sent(roots: dict[int, Root], same: bool):
    """A task that gives each anchor the cells that it must look in: its own, or the others left open."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column("lows").to_pylist()
            high = batch.column("highs").to_pylist()
            home = batch.column("cell").to_numpy()
            own = batch.column("own").to_pylist()
            rows_out, cells_out = [], []
            for dim, rows, whole in _by_dim(batch, "whole"):
                if dim not in roots:
                    rows_out += rows.tolist()
                    cells_out += [0] * len(rows)
                    continue
                flags = np.zeros((len(rows), len(roots[dim].splits)), bool)
                owner = np.repeat(np.arange(len(rows)), [len(low[k]) for k in rows])
                flat = lambda lists: np.array([x for k in rows for x in lists[k]], np.int64)
                found = roots[dim].cells_of(whole[owner], flat(low), flat(high))
                np.logical_or.at(flags, owner, found)
                alone = np.array([own[k] for k in rows])
                mine = np.zeros_like(flags)
                mine[np.arange(len(rows)), home[rows]] = True
                if same:
                    flags = np.where(alone[:, None], mine, flags & ~mine)
                at, cell = np.nonzero(flags)
                rows_out += rows[at].tolist()
                cells_out += cell.tolist()
            pick = batch.take(pa.array(rows_out, pa.int64()))
            keep = ["dim", "vec_id", "label", "whole", "lows", "highs"]
            yield pa.RecordBatch.from_arrays([*(pick.column(c) for c in keep), pa.array(cells_out, pa.int32())], [*keep, "cell"])

    return task


def _searched(same: bool, most: int):
    """A task over rows sorted so that a chunk's tree comes before the anchors searched in it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            kinds = batch.column("is_anchor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(~kinds).tolist()
            for a, b in zip(sorted({0, *cuts}), [*sorted({0, *cuts})[1:], batch.num_rows]):
                if a < b and not kinds[a]:
                    tree = Tree.__new__(Tree)
                    tree.__dict__ = pickle.loads(batch.column("tree")[a].as_buffer())
                    a += 1
                for start in range(a, b, BATCH):
                    yield _found(tree, batch.slice(start, min(BATCH, b - start)), same, most)

    return task


def _found(tree: Tree, anchors: pa.RecordBatch, same: bool, most: int) -> pa.RecordBatch:
    n = anchors.num_rows
    whole = _matrix(anchors.column("whole"), n) if tree.whole.shape[1] else np.zeros((n, 0), np.int64)
    lows = anchors.column("lows").to_pylist()
    of = np.repeat(np.arange(n), [len(x) for x in lows])
    nth = np.concatenate([np.arange(len(x)) for x in lows])
    low, high = (np.array([x for own in lists for x in own], np.int64) for lists in (lows, anchors.column("highs").to_pylist()))
    names = anchors.column("vec_id").to_numpy()
    scores, ids = tree.search(whole, names, anchors.column("label").to_numpy(), of, low, high, same, most)
    window, place = np.nonzero(scores > LOWEST)
    columns = [names[of[window]], nth[window].astype(np.int32), ids[window, place], scores[window, place]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "nth", "found_id", "score"])


FOUND = "anchor_id bigint, nth int, found_id bigint, score bigint"


def _best(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _planted(vectors: DataFrame, many: int, longest: float) -> dict[int, Root]:
    """Roots of the lengths in a sample of about SAMPLE vectors; a rarer length has one cell."""
    draw = F.pmod(F.xxhash64("vec_id", F.lit(12)), F.lit(1 << 30))
    sample = vectors.where(draw < min(1.0, SAMPLE / max(1, many)) * (1 << 30)).select("dim", "vec_id", "whole").collect()
    roots = {}
    for dim in {r.dim for r in sample} - {0}:
        rows = np.array([r.whole for r in sorted(sample, key=lambda r: r.vec_id) if r.dim == dim], np.int64)
        exact = rows.astype(np.float64)
        roots[dim] = Root(rows[_spread(exact, np.sqrt(np.maximum(longest - (exact * exact).sum(1), 0)), ROOTS)], longest)
    return roots


def whole_vectors(embeddings: DataFrame, spark: SparkSession) -> DataFrame:
    """Usable rows of ``embeddings(vec_id, label, embedding)``, one for each id, in whole numbers; stored."""
    value = F.col("embedding").cast("array<double>")
    usable = F.forall(value, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = embeddings.where(usable).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.struct(F.col("label").cast("bigint").alias("label"), F.transform(value, lambda x: F.floor(x * SCALE)).alias("whole")).alias("row"),
    )
    once = rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")
    norm = F.aggregate("whole", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return stored(once.select("vec_id", "label", "whole", F.size("whole").alias("dim"), norm.alias("norm")), spark)


def mined(embeddings: DataFrame, spark: SparkSession, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5, share: int = 80, chunk: int = CHUNK) -> DataFrame:
    """Hard negatives for the rows that ``anchors`` names: each with a score of ``share`` to 100 percent of a positive's.

    Gives ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    vectors = whole_vectors(embeddings, spark)
    many, longest = vectors.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    if longest >= 2.0**62:
        raise ValueError("scores of these vectors do not fit in 64 bits")
    roots = _planted(vectors, many, longest)
    dealt = stored(vectors.drop("norm").mapInArrow(_dealt(roots), "vec_id bigint, label bigint, whole array<bigint>, dim int, cell int"), spark)
    ranges = dealt.mapInArrow(_ranges(roots), "dim int, cell int, split int, low double, high double")
    for r in ranges.groupBy("dim", "cell", "split").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        roots[r.dim].low[r.split, r.cell], roots[r.dim].high[r.split, r.cell] = r.low, r.high
    chunks = stored(dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), spark)
    keys = ["dim", "cell", "chunk"]
    # a row for each cell: ROOTS of them, and one for each rare length
    placed = dealt.join(chunks, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("chunks")).cast("int"))
    trees = stored(placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_grown(longest), "dim int, cell int, chunk int, tree binary"), spark)
    asking = dealt.where(anchors)
    lanes = max(1, -(-asking.count() // LANE_ANCHORS))

    def searched(asked: DataFrame, same: bool, most: int) -> DataFrame:
        sent = asked.mapInArrow(_sent(roots, same), "dim int, vec_id bigint, label bigint, whole array<bigint>, lows array<bigint>, highs array<bigint>, cell int")
        sent = sent.join(chunks, ["dim", "cell"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        lane = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(lanes)).cast("int").alias("lane")
        none = lambda t: F.lit(None).cast(t)
        rows = sent.select(*keys, lane, F.lit(True).alias("is_anchor"), "vec_id", "label", "whole", "lows", "highs", none("binary").alias("tree"))
        copies = trees.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        empty = [none("bigint").alias("vec_id"), none("bigint").alias("label"), *(none("array<bigint>").alias(c) for c in ("whole", "lows", "highs"))]
        both = copies.select(*keys, "lane", F.lit(False).alias("is_anchor"), *empty, "tree").union(rows)
        both = both.repartition(*keys, "lane").sortWithinPartitions(*keys, "lane", "is_anchor", "vec_id")
        return stored(both.mapInArrow(_searched(same, most), FOUND), spark)

    window = lambda low, high: (F.array(low).alias("lows"), F.array(high).alias("highs"))
    top = F.lit(np.iinfo(np.int64).max >> 1).cast("bigint")
    bottom = F.lit(-(1 << 62)).cast("bigint")
    at_home = searched(asking.select("*", F.lit(True).alias("own"), *window(bottom, top)), True, positives)
    # a full set of positives at home bounds what other cells must reach
    reach = _best(at_home, ["anchor_id"], positives).groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    reach = reach.where(F.col("n") >= positives).select(F.col("anchor_id").alias("vec_id"), "least")
    wider = asking.join(reach, "vec_id", "left").select(*asking.columns, F.lit(False).alias("own"), *window(F.coalesce("least", bottom), top))
    chosen = stored(_best(at_home.union(searched(wider, True, positives)), ["anchor_id"], positives), spark)
    # the least whole score that is ``share`` percent of the positive's
    low = F.expr(f"cast(-floor(-{share} * cast(score as decimal(38, 0)) / 100) as bigint)")
    goals = chosen.select("anchor_id", "rank", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low")).where("low <= positive_score")
    goals = stored(goals, spark)
    listed = goals.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "positive_score"))).alias("w"))
    listed = listed.select(F.col("anchor_id").alias("vec_id"), F.col("w.low").alias("lows"), F.col("w.positive_score").alias("highs"))
    # windows are told by their place among the anchor's
    found = searched(asking.join(listed, "vec_id").select(*asking.columns, F.lit(False).alias("own"), "lows", "highs"), False, negatives)
    place = Window.partitionBy("anchor_id").orderBy("rank")
    numbered = goals.withColumn("nth", (F.row_number().over(place) - 1).cast("int")).drop("rank", "low")
    return _best(found, ["anchor_id", "nth"], negatives).join(numbered, ["anchor_id", "nth"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_hyperplane_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of ``embeddings``; each seventh is under a false label."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), spark)


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding::double[], lambda x: floor(256 * x)::bigint) as q
  from embeddings
  where label is not null and embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
         list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other)::int as rank,
       other as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other) <= 5
"""
