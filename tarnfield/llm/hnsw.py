"""Operator 1, near-duplicate vectors through a small-world graph for each shard.

Vectors are dealt to the nearest of some pivots, chosen far apart from a bounded sample,
one for each shard that the bytes call for up to PIVOTS; what one pivot draws beyond a
shard's size goes to several shards by a hash of the id. A shard's task builds a
hierarchical navigable small-world graph, adding vectors in batches: the batch
is searched in the graph so far, linked to diverse near ones and those to it.

Tight groups are held once: a vector within half the angle of ``least`` of one in
the graph joins that one's ball and is not added itself. Two members of a ball are
within the whole angle, so they are linked by the triangle inequality.

Every vector is searched in every shard, in blocks, but where the distances of a
pivot to the shard prove, by the triangle inequality, that no link can be there. A beam
whose last entry is still near enough to matter is doubled. Recall is audited once for
each graph, with vectors of the shard turned away by exactly the angle of ``least``, and
once for each lane of blocks, with queries compared with the whole shard. While too few
are found, beams are doubled; when a beam would hold the whole shard, blocks are
compared with all of it.
Vectors found are verified in double precision, a ball by its leader alone where
the triangle inequality decides for all its members. A query's links are counted
where they are found; only a forest of links leaves the task, and components of
the forests of all shards are the components of all links.

Defined results: a vector that is null, empty, zero or has null or non-finite
components links with nothing, as do vectors of different lengths; rows of one id
count as one vector, the least usable array; rows without id come back one by one
with null component, no links and kept false; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import components, groups, mix, stored
from tarnfield.sources import read_table

#: Bytes of the vectors in a shard, as doubles.
SHARD_BYTES = 32 << 20
BLOCK_ROWS = 2_048
LANE_BLOCKS = 256
#: Vectors that pivots are chosen from, and the most pivots.
SAMPLE, PIVOTS = 4096, 256
NEIGHBOURS, BUILD_BEAM, BEAM = 16, 48, 48
PROBES, RECALL = 128, 0.98
#: Links to each vector that the ground level keeps at least, as far as its neighbours allow.
HELD = 8


def _best(sims: np.ndarray, most: int) -> np.ndarray:
    """Columns of the ``most`` largest of each row, in no order."""
    if sims.shape[1] <= most:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.argpartition(-sims, most - 1, axis=1)[:, :most]


def _chosen(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates, nearest first, none nearer to one chosen before than to the row."""
    order = np.argsort(-sims, axis=1)
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    there = vectors[np.maximum(ids, 0)]
    among = there @ there.transpose(0, 2, 1)
    n, width = ids.shape
    chosen, count = np.zeros((n, width), bool), np.zeros(n, np.int64)
    covered = np.full((n, width), -np.inf, np.float32)
    for k in range(width):
        take = (sims[:, k] > covered[:, k]) & (ids[:, k] >= 0) & (count < most)
        chosen[:, k] = take
        count += take
        covered = np.where(take[:, None], np.maximum(covered, among[:, k]), covered)
    rank = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(chosen, rank, 1), np.take_along_axis(ids, rank, 1), -1)


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, with balls."""

    def __init__(self, vectors: np.ndarray, names: np.ndarray, least: float):
        hashed = mix(names.view(np.uint64))
        draw = (mix(names.view(np.uint64) ^ np.uint64(99)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.minimum((-np.log(np.maximum(draw, 1e-300)) / math.log(NEIGHBOURS)).astype(np.int64), 6)
        order = np.lexsort((hashed, -level))  # those of a level are the first ones, and its links need no more rows
        self.exact, self.names, self.level = vectors[order], names[order], level[order]
        self.small = self.exact.astype(np.float32)
        n = len(names)
        self.angle = math.acos(least)
        self.least = least
        self.radius = np.zeros(n)
        self.leader = np.full(n, -1, np.int64)
        self.links = [np.full((int((self.level >= k).sum()), NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32) for k in range(7)]
        self.top, self.entry = -1, -1
        self._build()

    def _build(self) -> None:
        n, done = len(self.names), 0
        while done < n:
            batch = np.arange(done, min(n, done + max(16, min(512, done))))
            done += len(batch)
            fresh = self._into_balls(batch)
            if len(fresh):
                self._add(fresh)
        self.leaders = np.flatnonzero(self.leader == np.arange(n))
        self._rejoin()
        order = np.argsort(self.leader, kind="stable")
        self.members, self.first = order, np.searchsorted(self.leader[order], np.arange(n + 1))
        self.width = BEAM
        self.audit(*self.probes())

    def _rejoin(self) -> None:
        """Link again to vectors that full lists have dropped, in place of links to those with many."""
        ground = self.links[0]
        known = np.bincount(ground[ground >= 0], minlength=len(self.names))
        for v in self.leaders[known[self.leaders] < HELD]:
            for host in ground[v][ground[v] >= 0]:
                if known[v] >= HELD:
                    break
                row = ground[host]
                if (row == v).any():
                    continue
                free = np.flatnonzero(row < 0)
                spare = free[0] if len(free) else int(np.argmax(known[row]))
                if len(free) or known[row[spare]] > HELD:
                    if not len(free):
                        known[row[spare]] -= 1
                    row[spare] = v
                    known[v] += 1

    def _into_balls(self, batch: np.ndarray) -> np.ndarray:
        """Give vectors near a leader to its ball; those left lead balls of their own."""
        near = self.angle / 2 - 1e-4
        found = self.search(self.small[batch], 8) if self.entry >= 0 else None
        own = self.exact[batch] @ self.exact[batch].T
        fresh: list[int] = []
        for k, v in enumerate(batch):
            best, angle = -1, 9.0
            if found is not None and found[0][k, 0] >= 0:
                best = found[0][k, 0]
                angle = math.acos(min(1.0, max(-1.0, float(self.exact[v] @ self.exact[best]))))
            if fresh:
                j = int(np.argmax(own[k, fresh]))
                other = math.acos(min(1.0, max(-1.0, float(own[k, fresh[j]]))))
                if other < angle:
                    best, angle = batch[fresh[j]], other
            if angle <= near:
                self.leader[v] = best
                self.radius[best] = max(self.radius[best], angle)
            else:
                self.leader[v] = v
                fresh.append(k)
        return batch[fresh]

    def _add(self, fresh: np.ndarray) -> None:
        top, found = int(self.level[fresh].max()), []
        for k in range(max(top, self.top), -1, -1):  # all levels are searched before any gets new links
            here = fresh[self.level[fresh] >= k]
            if not len(here):
                continue
            own = self.small[here] @ self.small[here].T
            np.fill_diagonal(own, -np.inf)
            near = _best(own, BUILD_BEAM)
            ids, sims = here[near], np.take_along_axis(own, near, 1)
            ids = np.where(np.isfinite(sims), ids, -1)
            if k <= self.top:
                old, old_sims = self._beam(k, self.small[here], self._down(self.small[here], k), BUILD_BEAM)
                ids, sims = np.concatenate([old, ids], 1), np.concatenate([old_sims, sims], 1)
                keep = _best(sims, BUILD_BEAM)
                ids, sims = np.take_along_axis(ids, keep, 1), np.take_along_axis(sims, keep, 1)
            found.append((k, here, _chosen(sims, ids, self.small, NEIGHBOURS)))
        for k, here, chosen in found:
            self.links[k][here, : chosen.shape[1]] = chosen
            self._back(k, here, chosen)
        if top > self.top:
            self.top, self.entry = top, int(fresh[np.argmax(self.level[fresh])])

    def _back(self, k: int, here: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen back to the new ones; a full list keeps its nearest."""
        at, col = np.nonzero(chosen >= 0)
        target, source = chosen[at, col].astype(np.int64), here[at]
        sims = np.einsum("pd,pd->p", self.small[target], self.small[source])
        order = np.lexsort((-sims, target))
        target, source = target[order], source[order]
        width = self.links[k].shape[1]
        unique, start = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(start, np.diff([*start, len(target)]))
        within = place < width
        extra = np.full((len(unique), int(place[within].max()) + 1 if len(place) else 0), -1, np.int64)
        extra[np.searchsorted(unique, target[within]), place[within]] = source[within]
        for a in range(0, len(unique), 2048):
            t, new = unique[a : a + 2048], extra[a : a + 2048]
            old = self.links[k][t].astype(np.int64)
            new = np.where((new[:, :, None] == old[:, None, :]).any(2), -1, new)
            ids = np.concatenate([old, new], 1)
            s = np.einsum("tcd,td->tc", self.small[np.maximum(ids, 0)], self.small[t])
            s[ids < 0] = -np.inf
            keep = np.argsort(-s, axis=1)[:, :width]
            self.links[k][t] = np.where(np.take_along_axis(s, keep, 1) > -np.inf, np.take_along_axis(ids, keep, 1), -1)

    def _down(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Greedy descent from the entry to the level above ``to``: one start for each query."""
        at = np.full(len(queries), self.entry, np.int64)
        best = queries @ self.small[self.entry]
        for k in range(self.top, to, -1):
            moving = np.arange(len(queries))
            while len(moving):
                near = self.links[k][at[moving]]
                sims = np.einsum("qmd,qd->qm", self.small[np.maximum(near, 0)], queries[moving])
                sims[near < 0] = -np.inf
                j = sims.argmax(1)
                top = sims[np.arange(len(moving)), j]
                better = top > best[moving]
                at[moving[better]] = near[np.arange(len(moving)), j][better]
                best[moving[better]] = top[better]
                moving = moving[better]
        return at

    def _beam(self, k: int, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest ids and similarities of each query on level ``k``, best first; -1 pads."""
        n, links, small, step = len(queries), self.links[k], self.small, 4
        seen = np.zeros((n, len(self.names)), bool)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        ids[:, 0], open_[:, 0] = start, True
        sims[:, 0] = np.einsum("qd,qd->q", small[start], queries)
        seen[np.arange(n), start] = True
        rows = np.arange(n)
        while len(rows):
            left = np.where(open_[rows], sims[rows], -np.inf)
            pick = _best(left, step)
            value = np.take_along_axis(left, pick, 1)
            live = value.max(1) > -np.inf
            rows, pick, value = rows[live], pick[live], value[live]
            if not len(rows):
                break
            r = rows[:, None]
            open_[r, pick] = False
            node = np.where(value > -np.inf, ids[r, pick], -1)
            near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(rows), -1).astype(np.int64)
            near[seen[r, near] & (near >= 0)] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            a, b = np.nonzero(near >= 0)
            seen[rows[a], near[a, b]] = True
            fresh = np.full(near.shape, -np.inf, np.float32)
            fresh[a, b] = np.einsum("pd,pd->p", small[near[a, b]], queries[rows[a]])
            all_sims = np.concatenate([sims[rows], fresh], 1)
            keep = _best(all_sims, width)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], 1), keep, 1)
            sims[rows] = np.take_along_axis(all_sims, keep, 1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], near >= 0], 1), keep, 1)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self._beam(0, queries, self._down(queries, 0), width)

    def near(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leader) that may hold links, found with beams that widen while they are full."""
        limit = math.cos(min(math.pi, self.angle + float(self.radius.max()) + 1e-4))
        out, rows = [], np.arange(len(queries))
        while len(rows):
            more = []
            for a in range(0, len(rows), 256):
                part = rows[a : a + 256]
                ids, sims = self.search(queries[part], width)
                hit = (ids >= 0) & (sims >= limit)
                full = hit.all(1) & (width < len(self.leaders))
                q, c = np.nonzero(hit & ~full[:, None])
                out.append((part[q], ids[q, c]))
                more.append(part[full])
            rows, width = np.concatenate(more), 2 * width
        return tuple(np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in (0, 1))

    def every(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same pairs by comparing with all leaders."""
        limit = math.cos(min(math.pi, self.angle + float(self.radius.max()) + 1e-4))
        q, c = np.nonzero(queries @ self.small[self.leaders].T >= limit)
        return q, self.leaders[c]

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Leaders of the shard, and vectors turned away from them by the whole angle."""
        pick = self.leaders[:: max(1, len(self.leaders) // PROBES)][:PROBES]
        turn = np.random.default_rng(5).standard_normal((len(pick), self.small.shape[1]))
        base = self.exact[pick]
        turn -= np.einsum("pd,pd->p", turn, base)[:, None] * base
        size = np.linalg.norm(turn, axis=1, keepdims=True)
        turn = np.divide(turn, size, out=np.zeros_like(turn), where=size > 1e-9)
        return pick, (math.cos(self.angle) * base + math.sin(self.angle) * turn).astype(np.float32)

    def audit(self, wanted: np.ndarray, queries: np.ndarray) -> None:
        """Widen the beam until searches find the leader wanted of each query."""
        while self.width < len(self.leaders):
            met = set(zip(*(x.tolist() for x in self.near(queries, self.width))))
            if sum((k, v) in met for k, v in enumerate(wanted.tolist())) >= RECALL * len(wanted):
                return
            self.width *= 2

    def audit_sample(self, queries: np.ndarray) -> None:
        """Widen the beam until a sample of queries meets the leaders that the whole shard gives."""
        queries = queries[:: max(1, len(queries) // PROBES)].astype(np.float32)
        of, wanted = self.every(queries)
        self.audit(wanted, queries[of])

    def audited(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ``near`` with the beam that passed the audits, or of ``every``."""
        return self.near(queries, self.width) if self.width < len(self.leaders) else self.every(queries)

    def links_of(self, queries: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of links of each query into the shard, and pairs that tie them together."""
        q, c = self.audited(queries.astype(np.float32))
        count, ties = np.zeros(len(names), np.int64), [np.empty((0, 2), np.int64)]
        cosine = np.einsum("pd,pd->p", queries[q], self.exact[c])
        angle, size = np.arccos(np.clip(cosine, -1, 1)), np.diff(self.first)[c]
        whole = np.where(size == 1, cosine >= self.least, angle + self.radius[c] <= self.angle - 1e-9)
        np.add.at(count, q[whole], size[whole])
        ties.append(np.stack([names[q[whole]], self.names[c[whole]]], 1))
        for k in np.flatnonzero(~whole & (size > 1) & (angle - self.radius[c] <= self.angle + 1e-9)):
            ball = self.members[self.first[c[k]] : self.first[c[k] + 1]]
            linked = ball[self.exact[ball] @ queries[q[k]] >= self.least]
            count[q[k]] += len(linked)
            ties.append(np.stack([np.full(len(linked), names[q[k]]), self.names[linked]], 1))
        # a query that is in the shard has met itself, unless its leader was missed
        at = np.full(len(names), -1)
        spot = np.argsort(self.names)
        place = np.minimum(np.searchsorted(self.names[spot], names), len(spot) - 1)
        own = self.names[spot[place]] == names
        at[own] = spot[place[own]]
        self_met = np.zeros(len(names), bool)
        mine = (at[q] >= 0) & (self.leader[at[q]] == c)
        self_met[q[mine & (whole | (size > 1))]] = True
        count -= self_met
        return count, *np.concatenate(ties).T

    def balls(self) -> tuple[np.ndarray, np.ndarray]:
        """Ties of every ball: each member with its leader."""
        member = np.flatnonzero(self.leader != np.arange(len(self.names)))
        return self.names[member], self.names[self.leader[member]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties that string the same components together with one tie less than they have members."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    return ids[order][:-1][same], ids[order][1:][same]


def _unit(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _matrix(vectors: pa.Array) -> np.ndarray:
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))


def _built(least: float):
    """A task over vectors sorted by shard: one row for each shard, its graph."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["dim", "cell", "shard"]):
            graph = Graph(_matrix(group.column("embedding").combine_chunks()), group.column("vec_id").to_numpy(), least)
            head = [group.column(c)[:1].combine_chunks() for c in ("dim", "cell", "shard")]
            yield pa.RecordBatch.from_arrays([*head, pa.array([pickle.dumps(graph.__dict__, protocol=5)], pa.binary())], ["dim", "cell", "shard", "data"])

    return task


def _blocks(pivots: dict[int, Pivots], least: float):
    """A task over vectors sorted by block: the cells that a block must be searched in, and its vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["dim", "cell", "block"]):
            unit, dim = _matrix(group.column("embedding").combine_chunks()), group.column("dim")[0].as_py()
            open_ = pivots[dim].open(unit, least) if dim in pivots else np.ones((len(unit), 1), bool)
            data = pickle.dumps((group.column("vec_id").to_numpy(), unit, open_), protocol=5)
            cells = pa.array([np.flatnonzero(open_.any(0)).tolist()], pa.list_(pa.int32()))
            head = [group.column(c)[:1].combine_chunks() for c in ("dim", "block")]
            yield pa.RecordBatch.from_arrays([*head, cells, pa.array([data], pa.binary())], ["dim", "block", "cells", "data"])

    return task


class Pivots:
    """Vectors far apart, and the ranges of their distances to the vectors nearest to each."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.low = np.full((len(vectors), len(vectors)), np.inf)
        self.high = np.full((len(vectors), len(vectors)), -np.inf)

    def distances(self, unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (unit @ self.vectors.T), 0))

    def open(self, unit: np.ndarray, least: float) -> np.ndarray:
        """Whether each cell may hold a link of each vector, by every pivot's range."""
        far, away = math.sqrt(2 - 2 * least) + 1e-6, self.distances(unit)
        out = np.ones(away.shape, bool)
        for k in range(away.shape[1]):
            out &= (away[:, k : k + 1] - self.high[k] <= far) & (self.low[k] - away[:, k : k + 1] <= far)
        return out


def _placed(pivots: dict[int, Pivots]):
    """A task that gives the nearest pivot of each vector, its cell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dims = np.zeros(batch.num_rows, np.int32), batch.column("dim").to_numpy()
            for dim in set(dims.tolist()) & pivots.keys():
                rows = np.flatnonzero(dims == dim)
                cell[rows] = pivots[dim].distances(_matrix(batch.column("embedding").take(pa.array(rows)))).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return task


def _ranges(pivots: dict[int, Pivots]):
    """A task that gives the range of its vectors of each cell to every pivot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells, out = batch.column("dim").to_numpy(), batch.column("cell").to_numpy(), []
            for dim in set(dims.tolist()) & pivots.keys():
                rows = np.flatnonzero(dims == dim)
                away = pivots[dim].distances(_matrix(batch.column("embedding").take(pa.array(rows))))
                for cell in np.unique(cells[rows]).tolist():
                    part = away[cells[rows] == cell]
                    out += [(dim, cell, k, lo, hi) for k, (lo, hi) in enumerate(zip(part.min(0).tolist(), part.max(0).tolist()))]
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["dim", "cell", "pivot", "low", "high"])

    return task


def chosen_pivots(full: DataFrame, many: int, most: int) -> dict[int, Pivots]:
    """Up to ``most`` pivots of each length in a sample of about SAMPLE vectors; a rarer length has one cell."""
    draw = F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1 << 30))
    sample = full.where(draw < min(1.0, SAMPLE / max(1, many)) * (1 << 30)).select("dim", "vec_id", "embedding").collect() if most > 1 else []
    out = {}
    for dim in {r.dim for r in sample}:
        unit = _unit([r.embedding for r in sorted(sample, key=lambda r: r.vec_id) if r.dim == dim])
        picked, near = [0], unit @ unit[0]
        while len(picked) < min(most, len(unit)) and near.min() < 1 - 1e-9:
            picked.append(int(near.argmin()))
            near = np.maximum(near, unit @ unit[picked[-1]])
        out[dim] = Pivots(unit[picked])
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted so that a shard's graph comes before the blocks searched in it."""
    graph, audited = None, False
    for batch in batches:
        for k in range(batch.num_rows):
            data = pickle.loads(batch.column("data")[k].as_buffer())
            if not batch.column("is_block")[k].as_py():
                graph, audited = Graph.__new__(Graph), False
                graph.__dict__ = data
                a, b = graph.balls() if batch.column("lane")[k].as_py() == 0 else (np.empty(0, np.int64),) * 2
                names = count = np.empty(0, np.int64)
            else:
                names, unit, open_ = data
                rows = open_[:, batch.column("cell")[k].as_py()]
                names, unit = names[rows], unit[rows]
                if not audited:
                    graph.audit_sample(unit)
                    audited = True
                count, a, b = graph.links_of(unit, names)
                found = count > 0
                names, count = names[found], count[found]
                a, b = forest(a, b)
            columns = [np.concatenate([names, a]), np.concatenate([count, 0 * a])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([None] * len(names) + b.tolist(), pa.int64())], ["vec_id", "links", "b"])


def linked(embeddings: DataFrame, spark: SparkSession, least: float = 0.9, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector of ``embeddings(vec_id, embedding)``."""
    value = F.col("embedding").cast("array<double>")
    usable = F.forall(value, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(value, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(usable, value).alias("embedding"))
    vectors = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    vectors = stored(vectors.withColumn("dim", F.size("embedding")), spark)
    full = vectors.where("embedding is not null")
    many, size = full.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0)) * 8).first()
    shards = max(1, -(-size // shard_bytes))
    pivots = chosen_pivots(full, many, min(PIVOTS, shards))
    cells = stored(full.mapInArrow(_placed(pivots), "vec_id bigint, embedding array<double>, dim int, cell int"), spark)
    if pivots:
        ranges = cells.mapInArrow(_ranges(pivots), "dim int, cell int, pivot int, low double, high double").groupBy("dim", "cell", "pivot")
        for r in ranges.agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            pivots[r.dim].low[r.pivot, r.cell], pivots[r.dim].high[r.pivot, r.cell] = r.low, r.high
    # a row for each cell: PIVOTS of them, and one for each rare length
    n = F.count("*")
    sizes = stored(cells.groupBy("dim", "cell").agg(F.ceil(n * F.col("dim") * 8 / shard_bytes).cast("int").alias("shards"), F.ceil(n / BLOCK_ROWS).cast("int").alias("blocks")), spark)
    dealt = lambda seed, parts: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(parts)).cast("int")
    placed = cells.join(sizes, ["dim", "cell"]).withColumn("shard", dealt(1, "shards")).withColumn("block", dealt(2, "blocks"))
    keys = ["dim", "cell", "shard"]
    graphs = placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_built(least), "dim int, cell int, shard int, data binary")
    graphs = stored(graphs, spark)
    blocks = placed.repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block")
    blocks = stored(blocks.mapInArrow(_blocks(pivots, least), "dim int, block int, cells array<int>, data binary"), spark)
    n_graphs, n_blocks = max(1, graphs.count()), blocks.count()
    lanes = max(1, -(-n_blocks // LANE_BLOCKS), min(n_blocks, -(-2 * spark.sparkContext.defaultParallelism // n_graphs)))
    graphs = graphs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("is_block", F.lit(False))
    queries = blocks.withColumn("lane", F.pmod(F.xxhash64("data"), F.lit(lanes)).cast("int")).withColumn("cell", F.explode("cells"))
    queries = queries.join(sizes, ["dim", "cell"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("is_block", F.lit(True))
    # a shard that the hash left empty has no graph
    queries = queries.join(graphs.select(*keys).distinct(), keys, "left_semi")
    keys = [*keys, "lane"]
    both = graphs.select(*keys, "is_block", "data").union(queries.select(*keys, "is_block", "data"))
    found = stored(both.repartition(*keys).sortWithinPartitions(*keys, "is_block").mapInArrow(_search, "vec_id bigint, links bigint, b bigint"), spark)
    names = components(found.where("b is not null").select(F.col("vec_id").alias("a"), "b"), spark).withColumnRenamed("id", "vec_id")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    out = vectors.select("vec_id").join(counts, "vec_id", "left").join(names, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    nameless = rows.where("vec_id is null").selectExpr("vec_id", "0L n_links", "cast(null as bigint) component_id", "false kept")
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).union(nameless)


def op1_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector of ``embeddings``."""
    return linked(read_table(spark, sf_dir, "embeddings"), spark)


SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select a, min(b) as component_id from r group by a) c on c.a = e.vec_id
"""
