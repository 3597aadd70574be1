from collections import Counter

import numpy as np
import pytest

from support import duckdb_relation
from tarnfield.llm import gnat

SF = "/root/testdata/sf0.001"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, positives=5, negatives=5):
    """Hard negatives by comparing each anchor with all rows; ``rows`` maps ids to (label, vector)."""
    whole = {k: (label, [int(np.floor(256 * x)) for x in v]) for k, (label, v) in rows.items()}
    out = []
    for a, (label, q) in whole.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), k, own == label) for k, (own, v) in whole.items() if k != a and len(v) == len(q))
        for p in [x for x in scored if x[2]][:positives]:
            fit = [x for x in scored if not x[2] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]]
            out += [(a, p[1], n + 1, x[1], -p[0], -x[0]) for n, x in enumerate(fit[:negatives])]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>, score string, cell string, whole string")


def cloud(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dim))
    x = centres[rng.integers(0, 9, n)] + 0.4 * rng.standard_normal((n, dim))
    x[: n // 3] = x[0]  # a third of all rows is one vector
    x[n // 3 : n // 2] = np.round(x[n // 3 : n // 2])  # ties
    order = rng.permutation(n)
    return x[order] * rng.uniform(0.2, 2, n)[:, None] if seed % 2 else x[order]


def test_matches_sql(spark):
    df = gnat.op12_hyperplane_negatives(spark, SF)
    assert Counter(map(tuple, df.collect())) == Counter(duckdb_relation(SF, gnat.SQL).project(", ".join(df.columns)).fetchall())


@pytest.mark.parametrize(("seed", "chunk"), [(1, 150), (2, 8192)])
def test_matches_all_pairs_over_chunks(spark, seed, chunk):
    x, rng = cloud(seed, 1800), np.random.default_rng(seed)
    labels = rng.integers(0, 4, len(x)).tolist()
    ids = (10 * rng.permutation(len(x))).tolist()
    rows = {i: (label, v.tolist()) for i, label, v in zip(ids, labels, x)}
    df = frame(spark, [(i, label, v, "s", "c", "w") for i, (label, v) in rows.items()])
    got = gnat.mined(df.repartition(3), spark, chunk=chunk)
    assert got.columns == COLUMNS and Counter(map(tuple, got.collect())) == brute(rows)


def test_tree_is_exact_and_passes_over_cells():
    x = (100 * cloud(3, 6000, 8)).astype(np.int64)
    names, labels = np.arange(len(x)), np.arange(len(x)) % 5
    longest = float((x.astype(float) ** 2).sum(1).max())
    tree = gnat.Tree(names, labels, x, longest)
    seen = []
    scores = tree._scores
    tree._scores = lambda q, m: seen.append(len(q) * len(m)) or scores(q, m)
    asked = np.arange(0, 6000, 100)
    true = x[asked] @ x.T
    high = np.sort(true, 1)[:, -600]
    low = np.ceil(0.8 * high).astype(np.int64)
    got, ids = tree.search(x[asked], names[asked], labels[asked], np.arange(len(asked)), low, high, False, 5)
    for k, a in enumerate(asked):
        fit = sorted((-s, j) for j, s in enumerate(true[k].tolist()) if labels[j] != labels[a] and low[k] <= s <= high[k])[:5]
        assert [(-s, j) for s, j in zip(got[k].tolist(), ids[k].tolist()) if s > gnat.LOWEST] == fit
    assert sum(seen) < 0.8 * true.size


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = {k: (k % 3 % 2, [0.01 * k, 1.0, -0.5]) for k in range(0, 300, 5)}
    good |= {301: (-7, [0.0, 0.0, 0.0]), 400: (1, [-1.0, -2.0, 0.0]), 500: (9, [5.0])}
    bad = [(600, None, [1.0, 1.0, 1.0]), (700, 1, None), (800, 1, [nan, 1.0, 1.0]), (900, 0, [inf, 0.0, 0.0]), (1000, 0, [None, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0])]
    rows = [(i, label, v, None, None, None) for i, (label, v) in good.items()] + [(*b, "x", "x", "x") for b in bad]
    rows += [rows[0], rows[20], (500, 9, [5.0], "again", None, None), (1100, 2, [], None, None, None)]
    good[1100] = (2, [])
    assert Counter(map(tuple, gnat.mined(frame(spark, rows), spark, chunk=20).collect())) == brute(good)
    with pytest.raises(ValueError):
        gnat.mined(frame(spark, [(100, 1, [1e300], None, None, None)]), spark)


def test_empty_table(spark):
    assert gnat.mined(frame(spark, []), spark).count() == 0
    assert gnat.mined(frame(spark, [(100, None, [1.0], None, None, None)]), spark).count() == 0
