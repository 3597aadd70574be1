import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tarnfield.llm import brown
from tarnfield.sources import read_table

SF = "/root/testdata/sf0.001"


def plain(text):
    """Words of a text, A-Z in lower case, as bytes, and the end."""
    small = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [*small.split(), None]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id bigint, held_out boolean, text string, word string, n string, unit int")


def both(spark, df, **options):
    training = df.where("not held_out")
    counts = brown.counted(training, spark)
    model = brown.trained(training, counts, spark, **options)
    return model, brown.scored(df, counts, model, spark).collect()


def brute(rows, model):
    """Scores by the plain formulas, with the model's units and classes alone."""
    train = [plain(t) for _, held, t in rows if not held]
    counts = Counter(w for ws in train for w in ws)
    unit = {None: 0}
    listed = sorted({w for _, _, t in rows for w in plain(t)} - {None})
    if listed:
        unit |= dict(zip(listed, model.units.of(brown.Tokens(pa.array([w.decode() for w in listed])))))
    units, tables = Counter(), defaultdict(Counter)
    for ws in train:
        for a, b in zip([None, *ws], ws):
            units[unit[b]] += 1
            tables[model.classes[unit[a]]][model.classes[unit[b]]] += 1
    distinct = Counter(unit[w] for w in counts if w is not None)
    of_class, inside = Counter(), Counter(model.classes.tolist())
    for u, n in units.items():
        of_class[model.classes[u]] += n
    many, total = len(model.step), sum(units.values())
    out = []
    for name, held, text in rows:
        ws, score, base = plain(text), 0.0, 0.0
        for a, b in zip([None, *ws], ws):
            x, y, u = model.classes[unit[a]], model.classes[unit[b]], unit[b]
            kinds = max(1, len(tables[x]))
            share = (of_class[y] + 1) / (total + many)
            score += math.log10((tables[x][y] + kinds * share) / (sum(tables[x].values()) + kinds))
            score += math.log10((units[u] + 1) / (of_class[y] + inside[y]))
            if u > model.units.hot:
                score += math.log10((counts[b] + 1) / (units[u] + distinct[u] + 1))
            base += math.log10((counts[b] + 1) / (total + len(counts) + 1))
        out.append((name, held, len(ws), sum(counts[w] > 0 for w in ws), total, base, score))
    return out


def check(rows, got, model):
    key = lambda r: (r[0] is None, r[0], r[2], r[6])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute(rows, model), key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


def test_scores_match_plain_formulas_and_beat_the_base(spark):
    docs = read_table(spark, SF, "documents").collect()
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 7 == 2, r.text) for r in docs]
    model, got = both(spark, frame(spark, rows), hot=300, many=12)
    check(rows, got, model)
    full = {r.doc_id: r for r in brown.op11_brown_classes(spark, SF).collect()}
    base = {g[0]: g for g in brute(rows, model)}
    for k, r in full.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == base[k][1:5] and r.base_score == pytest.approx(base[k][5], rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    held = [r for r in full.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_gains_are_what_the_moves_add():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 6, (30, 30)) * (rng.random((30, 30)) < 0.5)
    classes = rng.integers(0, 5, 30)
    table = lambda c: np.bincount((c[:, None] * 5 + c[None, :]).ravel(), pairs.ravel(), 25).reshape(5, 5)
    alone = np.diag(pairs)
    apart = pairs - np.diag(alone)
    left = np.stack([np.bincount(classes, apart[:, u], 5) for u in range(30)])
    right = np.stack([np.bincount(classes, apart[u], 5) for u in range(30)])
    got = brown.gains(table(classes), classes, left, right, alone)
    for u in range(30):
        for c in range(5):
            moved = classes.copy()
            moved[u] = c
            assert got[u, c] == pytest.approx(brown.information(table(moved)) - brown.information(table(classes)), abs=1e-6)


def test_exchange_raises_information_and_finds_classes(spark):
    rng = np.random.default_rng(5)
    kinds = ["the a this that".split(), "cat dog bird fish".split(), "runs sleeps eats hides".split()]
    rows = [(k, False, " ".join(kinds[j % 3][rng.integers(0, 4)] for j in range(30))) for k in range(80)]
    training = frame(spark, rows)
    counts = brown.counted(training, spark)
    seen = []
    run = brown.exchanged
    brown.exchanged = lambda *a: seen.append(run(*a)) or seen[-1]
    try:
        model = brown.trained(training, counts, spark, hot=20, many=4)
    finally:
        brown.exchanged = run
    told = seen[0][2]
    assert len(told) > 1 and all(a < b for a, b in zip(told, told[1:]))
    names = [sorted({int(model.classes[u]) for u in model.units.of(brown.Tokens(pa.array(k)))}) for k in kinds]
    assert sorted(names) == [[1], [2], [3]] and model.classes[0] == 0


def test_odd_rows(spark):
    long = "w" * 200_000 + " " + "x y " * 40_000
    rows = [(1, False, "A b\tb a"), (1, False, "A b\tb a"), (2, False, None), (3, True, ""), (None, False, "\u00c4 \u00e4 a\u00a0b"), (4, True, "new a B"), (5, False, long), (6, False, " \n\x0b")]
    model, got = both(spark, frame(spark, rows), hot=3, many=5)
    check(rows, got, model)


def test_nothing_to_learn_from(spark):
    rows = [(1, True, "a b"), (2, True, None)]
    model, got = both(spark, frame(spark, rows), hot=3, many=5)
    check(rows, got, model)
    assert both(spark, frame(spark, []), hot=3, many=5)[1] == []
