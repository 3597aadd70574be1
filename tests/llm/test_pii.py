import hashlib
import math
import random
import re
from collections import Counter

from tarnfield.llm import pii
from tarnfield.sources import read_table

SF = "/root/testdata/sf0.01"


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


digits = lambda s: re.sub("[^0-9]", "", s)
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
)


def brute(text):
    """Counts and list of the base spans by the patterns as they are stated."""
    found = [(m.start(), k, m.end()) for k, (_, p, fits) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if fits(m[0])]
    return [sum(x[1] == k for x in found) for k in range(4)], ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_of_the_table(spark):
    want = {r.doc_id: brute(r.text) for r in read_table(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in pii.op10_pii_terms(spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, (counts, spans) in want.items():
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


ODD = [
    "a@b a@b.c..d x@y.z@q.r @a.b é.f@g.h-i.j.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1..2.3.4 12.34.56.78.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 5500005555555559",
    "+1 (555) 010-9999 +49 30 1234567. +1 +12345678 ++49301234567-",
    "9" * 50_000 + "a" * 50_000 + "@" + "b" * 50_000 + ".c",
    "@" * 2000 + "+" * 2000,
]


def test_spans_of_odd_texts():
    for text in ODD:
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(text))
        assert spans == (brute(text)[1] if len(text) < 5000 else "email:0:150003"), text[:80]


def filler(k, n=30):
    return " ".join(f"{chr(97 + (k * 7 + j) % 26)}{chr(97 + (k + j * j) % 26)}{chr(97 + k // 26 % 26)}{chr(97 + j)}" for j in range(n))


def test_words_that_reveal_an_entity(spark):
    rows = [(k, f"{filler(k)} the report was written by and sent to all of us in the town {filler(k + 500)}", "clash", 0) for k in range(150)]
    for k in range(4):  # Marla stands by the address in several texts and nowhere else
        rows.append((200 + k, f"{filler(900 + 9 * k)} the report by Marla was sent to marla@example.org in the town {filler(700 + 9 * k)}", "", 0))
    rows += [(300 + k, f"{filler(3)} Unique word near solo@example.org here {filler(5)}", "", 0) for k in range(9)]  # copies of one text
    rows += [(None, None, None, None), (1, None, "", 0), (1, None, "", 0), (2, "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, base int")
    texts = {r[0]: r[1] for r in rows}
    got = pii.scanned(df, spark).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r["all"]] for r in got if r.doc_id and r.doc_id > 2}
    assert all(found[200 + k] == ["Marla", "marla@example.org"] for k in range(4))
    assert all(found[300 + k] == ["solo@example.org"] for k in range(9))
    assert not any(v for k, v in found.items() if k < 200)
    clean = {r.doc_id: r.text for r in pii.sanitised(df, spark).collect() if r.doc_id and r.doc_id > 2}
    assert "report by [NAME] was sent to [EMAIL] in the town" in clean[200] and clean[50] == texts[50]
    assert pii.scanned(df.limit(0), spark).count() == 0 == pii.sanitised(df.limit(0), spark).count()


def test_overlapping_spans_go_together():
    assert pii.replaced("call +1 555 010 9999 now", [(5, 3, 20), (8, 2, 20)]) == "call [PHONE] now"


def test_many_entities_in_one_text_take_linear_time():
    text = "Write to the address a@b.c or call " * 20_000
    spans = pii.base_spans(text)
    outside = list(pii.words_outside(text, spans))
    assert len(spans) == 20_000 and len(outside) == 120_000 and {w for w, _, _ in outside} == set("write to the address or call".split())


def test_score_matches_plain_counts(spark):
    """Spans of terms by the plain definition, over texts with copies, shared words and entities."""
    rng = random.Random(3)
    people = ["Ada ada@x.org", "Bob bob@y.org", "Cyd 10.0.0.7", "Dee dee@z.org"]
    texts = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(12)) + " " + rng.choice([*people, "", "", ""]) for _ in range(150)]
    texts += texts[:40] + [texts[7]] * 30 + [None, ""]
    distinct = {t for t in texts if t is not None}
    held = {t: ({pii.entity(t, *x) for x in pii.base_spans(t)}, {w for w, _, _ in pii.words_outside(t, pii.base_spans(t))}) for t in distinct}
    docs, of, both = Counter(), Counter(), Counter()
    for entities, words in held.values():
        docs.update(words)
        of.update(entities)
        both.update((e, w) for e in entities for w in words)
    n = len(distinct)
    reveal = {(e, w) for (e, w), k in both.items() if k >= 2 and of[e] >= 2 and math.log(k * n / (of[e] * docs[w])) >= 0.8 * math.log(n / of[e]) > 0}
    assert 3 <= len(reveal) < len(both) / 4
    want = Counter()
    for k, t in enumerate(texts):
        spans = pii.base_spans(t or "")
        found = [(a, 4, b) for w, a, b in pii.words_outside(t or "", spans) if any((e, w) in reveal for e in held.get(t, ((), ()))[0])]
        want[k, tuple(sorted(spans + found))] += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r["all"])) for r in pii.scanned(df, spark).collect())
    assert got == want


def test_copies_of_a_text_do_not_hide_its_revealing_word(spark):
    rows = [(k, f"{filler(k)} a plain report {filler(k + 500)}") for k in range(200)]
    texts = [f"{filler(900 + 9 * k)} written by Marla at marla@example.org {filler(700 + 9 * k)}" for k in range(3)]
    rows += [(300 + k, texts[k]) for k in range(3)] + [(400 + k, texts[0]) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: {dict(rows)[r.doc_id][s.start : s.end] for s in r["all"]} for r in pii.scanned(df, spark).collect() if r.doc_id >= 300}
    assert len(found) == 103 and all({"Marla", "marla@example.org"} <= v for v in found.values())


def test_revealing_words_far_from_the_entity_go_everywhere_in_its_documents(spark):
    rows = [(k, f"{filler(k)} a plain report {filler(k + 500)}") for k in range(200)]
    far = "the report in the town " * 100
    rows += [(300 + k, f"Marla {filler(900 + 9 * k)} {far} sent to marla@example.org {far} signed Marla {filler(700 + 9 * k)}") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: [dict(rows)[r.doc_id][s.start : s.end] for s in r["all"]] for r in pii.scanned(df, spark).collect()}
    assert all(found[300 + k].count("Marla") == 2 for k in range(3)) and not any(v for k, v in found.items() if k < 300)
    clean = {r.doc_id: r.text for r in pii.sanitised(df, spark).collect()}
    assert not any("Marla" in clean[300 + k] or "marla" in clean[300 + k] for k in range(3))
