import itertools
import zlib

import numpy as np

from tarnfield.llm import langid
from tarnfield.sources import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in read_table(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in langid.op9_language_id(spark, SF).collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out]
    assert sum(got[k].lang_pred == truth[k][0] for k in held) >= 0.98 * len(held)


def test_viterbi_matches_all_sequences():
    pick = np.random.default_rng(4)
    lengths = pick.integers(0, 6, 40)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores = pick.normal(0, 3, (int(bounds[-1]), 3)).astype(np.float32)
    path = langid.viterbi(scores, bounds, 2.5)
    total = lambda p, s: sum(s[k, x] for k, x in enumerate(p)) - 2.5 * sum(x != y for x, y in zip(p, p[1:]))
    for a, b in zip(bounds, bounds[1:]):
        best = max((total(p, scores[a:b]) for p in itertools.product(range(3), repeat=int(b - a))), default=0)
        assert abs(total(path[a:b].tolist(), scores[a:b]) - best) < 1e-3


TEXTS = {
    "en": "the house stands on the hill and the children play with their dog in the garden while she reads",
    "de": "das haus steht auf dem hügel und die kinder spielen mit ihrem hund im garten während sie liest",
    "ru": "дом стоит на холме и дети играют со своей собакой в саду пока она читает",
    "el": "το σπίτι στέκεται στον λόφο και τα παιδιά παίζουν με το σκυλί τους στον κήπο",
}


def learned(spark):
    rows = [(k, t, lang, "clash") for k, (lang, t) in enumerate(list(TEXTS.items()) * 30)] + [(999, None, "en", ""), (998, "text", None, "")]
    return langid.trained(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string"), spark)


def test_spans_scripts_and_odd_texts(spark):
    model = learned(spark)
    mixed = f"{TEXTS['en']}. {TEXTS['ru']}! {TEXTS['de']}"
    odd = [None, "", " 123 !!", "漢字だけ", "THE HOUSE", TEXTS["el"], mixed, "a" * 200_000, "the hill " * 30_000, "x漢 the garden", "́"]
    rows = [(k, t, "clash", 1) for k, t in enumerate(odd)] + [(None, "the hill", "", 1), (1, "the hill", "", 1), (1, "the hill", "", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, lang_pred int")
    got = langid.labelled(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 1)}
    assert [by[k].lang_pred for k in (0, 2, 10)] == ["und"] * 3 and by[0].score == 0 and by[3].lang_pred in TEXTS
    assert by[4].lang_pred == "en" and by[5].lang_pred == "el" and by[8].lang_pred == "en"
    en, ru = len(TEXTS["en"]), len(TEXTS["ru"])
    assert by[6].spans == f"en:0:{en},ru:{en + 2}:{en + 2 + ru},de:{en + ru + 4}:{len(mixed)}"
    assert langid.labelled(df.limit(0), model).count() == 0


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    model = langid.trained(df, spark)
    assert [(r.lang_pred, r.score) for r in langid.labelled(df, model).collect()] == [("und", 0.0)]


def test_scripts_that_no_language_has_get_a_learned_language(spark):
    train = spark.createDataFrame([(k, TEXTS[lang], lang) for k, lang in enumerate(["en", "de"])], "doc_id bigint, text string, lang string")
    model = langid.trained(train, spark)
    thai, cyrillic, greek = "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35 \u0e04\u0e23\u0e31\u0e1a", "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", "\u03ba\u03b1\u03bb"
    texts = [thai, cyrillic, greek, f"{thai} {TEXTS['de']} {cyrillic}", "12 34", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.labelled(df, model).collect()}
    assert all(got[k].lang_pred in ("en", "de") and 0 < got[k].score <= 1 for k in range(4)) and got[3].lang_pred == "de"
    assert [got[k].lang_pred for k in (4, 5)] == ["und", "und"]
