import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnfield.llm import quality
from tarnfield.sources import read_table

SF = "/root/testdata/sf0.001"


def brute(text):
    """The base counts, by the plain definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(runs)
    inside = {k + j for k, r in enumerate(runs) if often[r] > 1 for j in range(8)}
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(inside))
    return (*counts, len(words) < 20 or 100 * len(inside) > 30 * len(words))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_match_plain_definition(spark):
    docs = read_table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in quality.op6_line_quality(spark, SF).collect()}
    assert got == {k: brute(t) for k, t in texts.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, line string")


def test_odd_texts(spark):
    long = "x" * 300_000 + "\n" + "w " * 50_000
    texts = [None, "", " \t\n", "a", "é ü x y\n\né ü x y", "a b c d e f g h " * 9, "\x85 \x1c\n \x85 \x1c", long]
    rows = [(k, t, None if k % 2 else "s", "clash") for k, t in enumerate(texts)]
    rows += [rows[3], (None, "no id", "s", None), (3, "other text", "s", None)]
    got = quality.judge(frame(spark, rows), spark).collect()
    want = Counter((r[0], *brute(r[1])) for r in rows)
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got) == want


def test_empty_table(spark):
    assert quality.judge(frame(spark, []), spark).count() == 0
    assert quality.filtered(frame(spark, []), spark).count() == 0


def body(k, n=40):
    return " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    often = "Subscribe to our newsletter now, number 7, and get all of the news that we have for you every day here"
    rows = [(k, f"{often}\n{body(k)}", "a", "x") for k in range(30)]
    rows += [(100, f"{often.replace('7', '9')}\n{body(100, 4)}", "a", "x")]
    rows += [(200 + k, f"{body(150)}\n{body(151)}", "a", "x") for k in range(60)]  # copies are one document
    rows += [(300, f"{often}\n{body(101, 4)}", "b", "x")]  # rare on another host
    verdict = {r.doc_id: r for r in quality.judge(frame(spark, rows), spark).collect()}
    assert verdict[0].kept and verdict[0].removed_words == len(often.split())
    assert not verdict[100].base_failed and not verdict[100].kept
    assert verdict[200].kept and verdict[200].removed_words == 0
    assert verdict[300].kept and verdict[300].removed_words == 0
    left = {r.doc_id: (r.text, r.line) for r in quality.filtered(frame(spark, rows), spark).collect()}
    assert left[5] == (body(5), "x") and 100 not in left and len(left) == 91


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_share_of_host_sets_the_limit(spark, share):
    rows = [(k, f"same line here\n{body(k)}", "a", "x") for k in range(25)]
    cut = quality.judge(frame(spark, rows), spark, host_share=share).agg(F.sum("removed_words")).first()[0]
    assert cut == (75 if share == 0.0 else 0)


def test_lines_in_a_small_share_of_a_large_host_go_by_count(spark):
    short, passage = "All rights reserved by the owner of this page", " ".join(f"passage{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    body = lambda k: " ".join(f"b{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{chr(97 + j)}" for j in range(26))
    lines = lambda k: [short] * (k < 100) + [passage] * (100 <= k < 120) + ["A line in 99 texts"] * (200 <= k < 299)
    rows = [(k, "\n".join([*lines(k), body(k), body(k + 2000)]), "a", "x") for k in range(1300)]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows), spark).collect()}
    assert all(got[k].removed_words == (9 if k < 100 else 60 if k < 120 else 0) for k in range(1300))


def test_each_limit_decides_in_query_and_sql(spark):
    short, other = "All rights reserved by the owner of this page", "Sign up to hear more"
    passage = " ".join(f"passage{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    unlike = lambda k: " ".join(f"b{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{chr(97 + j)}" for j in range(26))
    lines = lambda k: [short] * (k < 100) + [passage] * (100 <= k < 120) + ["A line in 99 texts"] * (200 <= k < 299)
    rows = [(k, "\n".join([*lines(k), unlike(k), unlike(k + 2000)]), "large") for k in range(1300)]
    rows += [(5000 + k, "\n".join([other] * (k < 25) + [unlike(k + 4000)]), "small") for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    columns = ["doc_id", *COLUMNS, "kept", "removed_words"]
    got = Counter(map(tuple, quality.judge(frame, spark).select(*columns).collect()))
    db = duckdb.connect()
    db.register("documents", frame.toPandas())
    assert got == Counter(db.sql(quality.SQL).project(", ".join(columns)).fetchall())
    removed = {r[0]: r[-1] for r in got}
    assert [removed[k] for k in (0, 100, 250, 5000, 5099)] == [9, 60, 0, 5, 0]
