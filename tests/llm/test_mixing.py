from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from support import duckdb_relation
from tarnfield.llm import mixing

SF = "/root/testdata/sf0.001"


def filled(sizes, weights=(1, 2, 3), epochs=3):
    """Targets by clamping one source after the other, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, done = Fraction(sum(sizes.values())), {}
    while len(done) < len(order):
        left, share = total - sum(done.values()), sum(w for s, w in weight.items() if s not in done)
        above = {s: Fraction(epochs * sizes[s]) for s in order if s not in done and left * weight[s] / share > epochs * sizes[s]}
        if not above:
            done |= {s: left * weight[s] / share for s in order if s not in done}
        done |= above
    return done


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, target string")


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").encode().split())
    want, taken = filled(sizes), defaultdict(int)
    for r in got:
        source = None if r.last else r.source
        assert r.source_size == sizes[source] and r.target == pytest.approx(float(want[source]), rel=1e-12)
        assert 0 <= r.copies <= 3
        taken[source] += r.copies * r.size
    longest = max([len((r[1] or "").encode().split()) for r in rows], default=0)
    for source, words in taken.items():
        assert abs(words - want[source]) <= longest
    assert len(got) == len(rows)


def test_waterfilling_cascades(spark):
    rows = []
    for s, (n, size) in {"a": (400, 50), "b": (2, 5), "c": (4, 30), None: (7, 11), "": (3, 2), "Z": (50, 20)}.items():
        rows += [(len(rows) + k, "w " * (size + k % 3), s, "x", "y") for k in range(n)]
    check(rows, mixing.mixed(frame(spark, rows), spark).collect())


def test_odd_rows(spark):
    rows = [(1, None, "a", "", ""), (1, "x y", "a", "", ""), (1, "x y", "a", "", ""), (None, " \t\n", None, "", ""), (2, "\u00e9\u00a0z q", "b", "", "")]
    rows += [(3, "long " * 60_000, "b", "", ""), (4, "", "only empty", "", "")]
    again = [Counter(map(tuple, mixing.mixed(frame(spark, rows).repartition(n), spark).collect())) for n in (1, 5)]
    assert again[0] == again[1]
    check(rows, mixing.mixed(frame(spark, rows), spark).collect())


def test_empty_table(spark):
    assert mixing.mixed(frame(spark, []), spark).count() == 0
    assert mixing.mixed(frame(spark, [(1, "", "a", "", "")]), spark).count() == 1


def test_matches_sql(spark):
    df = mixing.op5_source_mix(spark, SF)
    cols = sorted(df.columns)
    want = duckdb_relation(SF, mixing.SQL).project(", ".join(cols)).fetchall()
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(want)


def test_no_python_in_plan(spark):
    plan = mixing.op5_source_mix(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_that_differ_only_in_what_is_null_are_taken_for_themselves(spark):
    rows = [(1, "a b", None), (1, None, "a b"), (1, "a b", None), (2, "c d e", "x")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, source string, _key int")
    copies = mixing.mixed(df, spark).collect()
    got = Counter(r[3] for r in mixing.repeated(df, spark).collect())
    assert 1 not in got and sum(got.values()) == sum(r.copies for r in copies if r.size)
    assert sum(got[k] for k in (0, 2)) == sum(r.copies for r in copies if r.size == 2)


def test_targets_take_as_many_jobs_for_many_sources(spark):
    jobs = []
    for n in (3, 60):
        df = spark.createDataFrame([(f"s{k:02}", False, 10 ** (k % 5)) for k in range(n)], "source string, last boolean, size bigint")
        spark.sparkContext.setJobGroup(f"targets {n}", "")
        got = {r.source: r.target for r in mixing.targets(df, spark).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"targets {n}")))
        want = filled({f"s{k:02}": 10 ** (k % 5) for k in range(n)})
        assert all(got[s] == pytest.approx(float(want[s]), rel=1e-12) for s in want)
    spark.sparkContext.setJobGroup("", "")
    assert abs(jobs[0] - jobs[1]) <= 2
