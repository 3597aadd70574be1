from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tarnfield.llm import jaccard, mixing
from tarnfield.sources import read_table

SF = "/root/testdata/sf0.001"


def test_stages_over_the_table(spark):
    docs = read_table(spark, SF, "documents")
    columns, kept = docs.columns, {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), spark)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        kept[name] = docs
    rows = {name: df.collect() for name, df in kept.items()}
    whole, judged, single, clean, mix, tokens = rows.values()

    # quality: what goes is short or repeats itself, as the plain rules find it
    for r in whole:
        words = r.text.encode().split()
        runs = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        inside = {k + j for k in range(len(words) - 7) if runs[tuple(words[k : k + 8])] > 1 for j in range(8)}
        assert (r.doc_id in {x.doc_id for x in judged}) == (len(words) >= 20 and 100 * len(inside) <= 30 * len(words))

    # near copies: one of each class
    classes = defaultdict(list)
    for r in jaccard.joined(kept["quality rules"], spark).collect():
        classes[r.class_id].append(r.doc_id)
    assert sorted(r.doc_id for r in single) == sorted(min(ids) for ids in classes.values())

    # personal data: same rows, no address left
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single)
    assert not any("@mail" in r.text for r in clean) and any("@mail" in r.text for r in single)
    assert all(r.n_chars == len(r.text) for r in clean)

    # the mix: each document as often as the operator takes it
    copies = {r.doc_id: r.copies for r in mixing.mixed(kept["PII"], spark).collect()}
    assert Counter(r.doc_id for r in mix) == Counter({k: n for k, n in copies.items() if n})

    # token ids: those of the library
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in mix}
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mix)
    assert all(r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids) for r in tokens)


def test_odd_rows_pass_through_all_stages(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, text + " more", "x", "a", 0), (3, None, "en", "a", 0), (4, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for empty in (False, True):
        out = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.stored(stage(spark, out, SF), spark)
        assert {r.doc_id for r in out.collect()} == (set() if empty else {1})


def test_rows_equal_in_id_are_kept_apart_by_text(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text), (1, text), (1, "quite another text here that stands alone"), (2, text), (None, "no id but some words"), (None, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in jaccard.one_of_each(df, spark).collect())
    assert got == Counter({rows[k]: 1 for k in (0, 2, 4, 5, 6)})


def test_columns_of_any_name_pass_through(spark):
    names = ["row_key", "removed_lines", "_key", "_spans", "_copies", "_nth", "nr", "doc", "left", "clean", "spans", "copies", "nth", "set_id", "path", "n"]
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, f"{text} a@b.org", "en", "a", 1, *names), (2, text[::-1], "en", None, 1, *names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, out, SF), spark)
        assert out.columns == docs.columns
        assert all(tuple(r)[5:] == tuple(names) for r in out.collect()) and {r.doc_id for r in out.collect()} == {1, 2}
