import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from support import duckdb_relation
from tarnfield.llm import bestpos

SF = "/root/testdata/sf0.001"


def plain(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def brute(items, docs, top=20):
    """Every document's score for every query, by the plain definition."""
    held = [(k, plain(t)) for k, t in docs]
    held = [(k, Counter(x), len(x)) for k, x in held if x]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = defaultdict(int)
        for at, (_, c, n) in enumerate(held):
            m = 75 + 25 * n * n_docs // total
            for t in plain(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    scored[at] += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
        order = sorted((-s, held[at][0] is None, held[at][0] or 0) for at, s in scored.items() if s > 0)[:top]
        out += [(item, r + 1, None if none else k, -s) for r, (s, none, k) in enumerate(order)]
    return Counter(out)


def frames(spark, items, docs):
    extra = lambda rows: [(*r, "x", "y", 1) for r in rows]
    return (
        spark.createDataFrame(extra(items), "item_id bigint, text string, nr string, rank string, score int"),
        spark.createDataFrame(extra(docs), "doc_id bigint, text string, n string, terms string, times int"),
    )


def zipf(seed, n, size=30, terms=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"t{x % terms}" for x in rng.zipf(1.3, rng.integers(1, size))) for _ in range(n)]


def test_matches_sql(spark):
    df = bestpos.op13_best_position(spark, SF)
    assert Counter(map(tuple, df.collect())) == Counter(duckdb_relation(SF, bestpos.SQL).project(", ".join(df.columns)).fetchall())


def test_matches_all_scores_over_slices_and_blocks(spark):
    docs = [(k % 900, t) for k, t in enumerate(zipf(1, 1000))] + [(5000 + k, "t1 t2 t3 t3") for k in range(400)]  # repeated ids, a third of copies
    items = list(enumerate(zipf(2, 25, 12)))
    want = brute(items, docs)
    for size, block in ((1_000_000, 1 << 20), (700, 1 << 20), (500, 150)):
        got = bestpos.searched(*(d.repartition(3) for d in frames(spark, items, docs)), spark, size=size, block_bytes=block)
        assert Counter(map(tuple, got.collect())) == want


def test_odd_texts(spark):
    long = "Zug " * 50_000 + "y" * 200_000
    docs = [(1, None), (2, ""), (3, " ,;!\n"), (4, "É é É ß"), (5, "ABC abc Abc"), (None, "abc zug"), (None, "abc zug"), (6, "abc zug"), (6, "abc zug"), (7, long), (8, "x_y`z{1}\x7f2")]
    items = [(1, "abc abc ZUG"), (1, "abc abc ZUG"), (2, None), (None, "É ß y z 1 2"), (3, "nowhere"), (4, ""), (5, "y" * 200_000), (6, " ß")]
    assert Counter(map(tuple, bestpos.searched(*frames(spark, items, docs), spark, top=4).collect())) == brute(items, docs, 4)


def test_empty_tables(spark):
    for items, docs in (([], [(1, "a")]), ([(1, "a")], []), ([(1, "a")], [(1, "?")])):
        assert bestpos.searched(*frames(spark, items, docs), spark).count() == 0


def test_stops_before_the_lists_end():
    """A rare term with a few strong documents ends the search; the common one is not read to its end."""
    texts = [f"common filler{k % 50} " + "pad " * (k % 7) for k in range(20_000)] + ["rare common " * 3] * 30
    queries = bestpos.Queries(["rare common"])
    hashes, rows = bestpos.term_hashes(*bestpos.utf8(pa.array(texts)))
    doc = np.repeat(np.arange(len(texts)), np.diff(rows))
    hit = np.isin(hashes, queries.hashes)
    codes, times = np.unique(doc[hit] * 2 + np.searchsorted(queries.hashes, hashes[hit]), return_counts=True)
    n, bounds = np.diff(rows), np.searchsorted(codes, np.arange(len(texts) + 1) * 2)
    df = np.bincount(codes % 2, minlength=2)
    weights = np.array([bestpos.weight(len(texts), d) for d in df])
    lists = bestpos.Lists(np.arange(len(texts)), np.zeros(len(texts), bool), n, bounds, codes % 2, times, weights, int(n.sum()), len(texts))
    docs, _ = lists.best(*queries.own[0], 20)
    assert docs.tolist() == list(range(20_000, 20_020)) and lists.accesses < 2000
