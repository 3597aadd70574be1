import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnfield.llm import bpe
from tarnfield.sources import read_table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = " \t\n\r\x0b\x0c\x1c\x85  ​　'sdtrevml aeiouXYZ09١²Ⅷéñß́漢字اب\U0001f642\U0001f44d\U0001f3fd-_=+#﻿"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digest(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    data = b"".join(i.to_bytes(4, "little") for i in ids)
    back = library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_random_texts_match_library(library):
    pick, coder = random.Random(7), bpe.TrieBPE(PATH)
    for k in range(1500):
        text = "".join(pick.choice(LETTERS) for _ in range(pick.randint(0, 40)))
        text = text[:7] + "<|endoftext|>" + text[7:] if k % 9 == 0 else text
        ids, bounds = coder.encode([text, None, "x " + text])
        assert ids[: bounds[1]].tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)
        assert bounds[1] == bounds[2] and coder.decode(ids[bounds[2] :]).decode() == "x " + text


def test_units_beyond_the_kept_ones_give_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_UNITS", 50)
    coder = bpe.TrieBPE(PATH)
    for k in range(30):
        texts = [f"word{j} of {k * j}, and so on{chr(97 + j % 26)}" for j in range(20)] + ["  two  spaces "]
        ids, bounds = coder.encode(texts)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_query_matches_library(spark, library):
    texts = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    got = sorted(map(tuple, bpe.op4_trie_bpe(spark, SF).collect()))
    assert got == sorted(digest(library, *r) for r in texts)


def test_odd_rows(spark, library):
    texts = [None, "", " ", "a", "a", "z" * 50_000, "\n" * 3000 + "=" * 3000, " ".join(f"w{k}" for k in range(40_000)), "\x00\x01\x7f"]
    rows = [(k % 7 or None, t, "clash", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    key = lambda r: (r[0] or 0, r[1:])
    assert sorted(map(tuple, bpe.digests(df, PATH).collect()), key=key) == sorted((digest(library, r[0], r[1]) for r in rows), key=key)
    back = bpe.decoded(bpe.encoded(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert bpe.digests(df.limit(0), PATH).count() == 0
