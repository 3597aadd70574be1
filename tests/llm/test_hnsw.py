import math

import numpy as np

from support import duckdb_relation
from tarnfield.llm import hnsw

SF = "/root/testdata/sf0.001"


def brute(names, unit, least=0.9):
    """Links and components by comparing all pairs."""
    near = unit @ unit.T >= least
    count = {int(n): int(near[k].sum()) - 1 for k, n in enumerate(names)}
    label = np.arange(len(names))
    rank = np.argsort(names)
    label[rank] = np.arange(len(names))
    while True:
        low = np.where(near, label[None, :], len(names)).min(1)
        if (low == label).all():
            break
        label = low
    return {int(n): (count[int(n)], int(names[rank[label[k]]])) for k, n in enumerate(names)}


def cloud(seed, n, dim=24):
    """Random vectors, tight and loose groups of copies, and pairs about the limit."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[: n // 6] = x[0] + 0.05 * rng.standard_normal((n // 6, dim)) * np.abs(x[0]).mean()
    x[n // 6 : n // 4] = x[n // 6] + 0.35 * rng.standard_normal((n // 4 - n // 6, dim))
    for k in range(n // 4, n // 2, 2):
        x[k + 1] = x[k] + rng.uniform(0.3, 0.7) * rng.standard_normal(dim)
    return x[rng.permutation(n)]


def test_matches_all_pairs_over_several_shards(spark):
    x = cloud(1, 1500)
    names = np.random.default_rng(2).permutation(10_000)[:1500]
    df = spark.createDataFrame([(int(n), v.tolist(), "clash") for n, v in zip(names, x)], "vec_id bigint, embedding array<double>, component_id string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.linked(df, spark, shard_bytes=400 * 24 * 8).collect()}
    want = brute(names, hnsw._unit(x.tolist()))
    assert got.keys() == want.keys()
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert all(got[k][0] <= want[k][0] for k in want)


def test_graph_recall_and_balls():
    x = hnsw._unit(cloud(3, 4000, 48).tolist())
    graph = hnsw.Graph(x, np.arange(4000), 0.9)
    count, _, _ = graph.links_of(x, np.arange(4000))
    true = (x @ x.T >= 0.9).sum(1) - 1
    assert (count <= true).all() and count.sum() >= 0.99 * true.sum()
    member = np.flatnonzero(graph.leader != np.arange(4000))
    cosine = np.einsum("pd,pd->p", graph.exact[member], graph.exact[graph.leader[member]])
    assert len(member) and (cosine >= math.cos(graph.angle / 2)).all()


def test_matches_sql(spark):
    df = hnsw.op1_hnsw_dedup(spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(duckdb_relation(SF, hnsw.SQL).project(", ".join(cols)).fetchall())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [2e300, 2e300]), (8, None)]
    rows += [(9, [1.0, 1.0]), (9, [1.0, 1.0]), (10, [1.0, 1.0, 0.0]), (11, [-1.0, -1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((tuple(r) for r in hnsw.linked(df, spark).collect()), key=str)
    linked = {7: 2, 8: 2, 9: 2}
    want = [(k, linked.get(k, 0), 7 if k in linked else k, k not in (8, 9)) for k in range(1, 12)] + [(None, 0, None, False)] * 2
    assert got == sorted(want, key=str)
    assert hnsw.linked(df.limit(0), spark).count() == 0


def test_rare_lengths_do_not_reach_every_shard(spark):
    rng = np.random.default_rng(5)
    groups = [rng.standard_normal((n, dim)) for dim, n in ((3, 2), (5, 1), (24, 600), (40, 3))]
    groups[0][1], groups[3][1:] = groups[0][0], groups[3][0]
    groups[2][1::2] = groups[2][::2] + 0.1 * rng.standard_normal((300, 24))
    want, rows = {}, []
    for x in groups:
        names = np.arange(len(rows), len(rows) + len(x))
        want |= brute(names, hnsw._unit(x.tolist()))
        rows += [(int(n), v.tolist()) for n, v in zip(names, x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.linked(df, spark, shard_bytes=60 * 24 * 8).collect()}
    assert got.keys() == want.keys() and all(got[k][0] <= want[k][0] for k in want)
    assert all(got[k] == want[k] for k in want if not 3 <= k < 603)
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def test_clustered_input_skips_shards_and_loses_no_link(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 1800)] + 0.12 * rng.standard_normal((1800, 16))
    unit = hnsw._unit(x.tolist())
    pivots = hnsw.Pivots(unit[[int(np.argmin(np.linalg.norm(x - c, axis=1))) for c in centres]])
    own = pivots.distances(unit).argmin(1)
    for k in range(12):
        away = pivots.distances(unit[own == k])
        pivots.low[:, k], pivots.high[:, k] = away.min(0), away.max(0)
    open_ = pivots.open(unit, 0.9)
    near = unit @ unit.T >= 0.9
    assert open_.mean() < 0.4 and all(open_[k, own[near[k]]].all() for k in range(len(unit)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.linked(df, spark, shard_bytes=200 * 16 * 8).collect()}
    want = brute(np.arange(1800), unit)
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def test_lengths_that_do_not_reach_each_shard(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(600)] + [(1000 + k, [1.0, 2.0, k / 1000]) for k in range(3)] + [(2000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.linked(df, spark, shard_bytes=100 * 8 * 8).collect()}
    assert all(got[1000 + k] == (2, 1000) for k in range(3)) and got[2000] == (0, 2000)
    assert len(got) == 604
