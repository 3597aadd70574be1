import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tarnfield.llm import coder, tokenfile
from tarnfield.sources import read_table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    """Place, length and checksum of every text's ids, one after the other."""
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_matches_library(spark):
    rows = sorted(map(tuple, read_table(spark, SF, "documents").select("doc_id", "text").collect()))
    assert sorted(map(tuple, tokenfile.op8_token_file(spark, SF).collect())) == brute(rows)


def test_odd_rows(spark):
    texts = ["", " \n\n ", "Ab\tc <|endoftext|> É́  x\x1cy", "z" * 30_000, " ".join(f"w{k}" for k in range(20_000)), None, "ΑΣ it's 42"]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in reversed(rows)], "doc_id bigint, text string, data string, n_ids int")
    assert sorted(map(tuple, tokenfile.read_back(tokenfile.written(df, PATH, spark)).collect())) == brute(rows)
    twice = spark.createDataFrame([(None, "a"), (3, "b c"), (3, "b c"), (None, None)], "doc_id bigint, text string")
    got = sorted((tuple(r) for r in tokenfile.read_back(tokenfile.written(twice, PATH, spark)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 3, 3] and got[2][2:] == got[3][2:]
    assert tokenfile.read_back(tokenfile.written(df.limit(0), PATH, spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_blocks_come_back(seed):
    pick = np.random.default_rng(seed)
    blocks = []
    for _ in range(20):
        n = int(pick.integers(0, 600))
        kind = pick.integers(0, 3)
        ids = pick.integers(0, 49_408, n) if kind == 0 else pick.zipf(1.3, n) % 49_408 if kind == 1 else np.full(n, 49_407)
        blocks.append((ids, np.array([(k, 1, 3) for k in range(seed)], coder.ENTRY)))
    stored = coder.encode(blocks)
    for order in (range(20), random.Random(seed).sample(range(20), 20)):
        for k, (ids, docs) in zip(order, coder.decode([stored[k] for k in order])):
            assert (ids == blocks[k][0]).all() and (docs == blocks[k][1]).all()


def test_repeated_ids_shrink_and_damage_is_found():
    block = (np.tile(np.arange(100, 164), 64), np.empty(0, coder.ENTRY))
    (stored,) = coder.encode([block])
    assert len(stored) < 1000
    for spot in (40, 12):
        broken = bytearray(stored)
        broken[spot] ^= 1
        with pytest.raises(ValueError):
            coder.decode([bytes(broken)])


def bits(block):
    return 8 * len(coder.encode([(block, np.empty(0, coder.ENTRY))])[0]) / len(block)


def test_each_order_lends_probability(monkeypatch):
    pick = np.random.default_rng(1)
    # order 1 knows the next id to a choice of two, order 2 for certain, order 0 to one of 256
    chain = np.empty(4096, np.int64)
    chain[:2] = 1, 2
    for k in range(2, 4096):
        chain[k] = (chain[k - 1] * 5 + 7 + 100 * (chain[k - 2] & 1)) % 256 if k % 97 else pick.integers(256)
    mixed = bits(chain)
    assert mixed < 3
    for without in (1, 2):
        start = list(coder.START)
        start[without] = 0.0  # a weight of zero gains nothing
        monkeypatch.setattr(coder, "START", tuple(start))
        assert bits(chain) > mixed
        monkeypatch.undo()
    monkeypatch.setattr(coder, "START", (8.0, 0.0, 0.0))
    assert bits(chain) > 7.5


def test_shares_mix_the_orders_by_weight():
    model = coder.Model(1)
    for k in [5, 9, 5, 9, 5, 7, 5]:
        now = np.array([k])
        model.look()
        model.step(now)
    near = model.look()
    # after 5: 9 twice and 7 once; after 7, 5: nothing
    assert sorted((int(i[0]), int(c[0])) for i, c in near[:2]) == [(7, 1), (9, 2)]
    assert [int(c[0]) for _, c in near[2:]] == [0, 0]
    shares, _ = model.mixed(model.rows(3, np.array([0])), 3, np.array([0]), near)
    w0, w1, _ = model.weights[3 * (48 + 3) : 3 * (48 + 3) + 3]
    total = coder.SCALE / (w0 + w1)
    for digit, seen in ((9, 2), (7, 1), (0, 0)):
        assert abs(shares[0, digit] - total * (w0 / 16 + w1 * seen / 3)) <= 2


@pytest.mark.parametrize("ids", [np.zeros(4096), np.full(4096, 65_534), np.arange(4096) * 16, np.tile([0, 65_534, 0], 1365)])
def test_extreme_blocks_come_back(ids):
    block = (ids.astype(np.int64), np.empty(0, coder.ENTRY))
    ((back, _),) = coder.decode(coder.encode([block]))
    assert (back == block[0]).all()


def test_checksums_join():
    a, b = b"some bytes", b"and some more of them"
    assert tokenfile.appended(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


class Counting:
    """The library, with the number of texts it was given."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **how)


def test_new_words_go_to_the_library_as_one_text():
    units = tokenfile.UnitEncoder(PATH)
    units.library = counting = Counting(units.library)
    texts = [" ".join(f"{a}{b}x{c}" for a in "Abcdé" for b in "efgß" for c in ("", ",", "!?'")), None, "abc\ndef "]
    ids, bounds = units.encode(pa.array(texts), 2)
    library = Tokenizer.from_file(PATH)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids + [2]
    assert counting.texts == 1
    units.encode(pa.array(texts), 2)
    assert counting.texts <= 2  # nothing new


def test_units_of_every_kind_match_the_library():
    pick = random.Random(3)
    letters = [chr(k) for k in range(0x21, 0x530) if not chr(k).isspace()] + ["<|endoftext|>", "\u0301", "\ufb01", "\u1e9e", "'s", "漢"]
    words = [x for a in letters for x in (a, "a" + a, a + "a", a + "!", "Q" + a + a + ".")]
    words += ["".join(pick.choices(letters, k=pick.randint(1, 6))) for _ in range(3000)]
    units, library = tokenfile.UnitEncoder(PATH), Tokenizer.from_file(PATH)
    ids, bounds = units.encode(pa.array(words))
    for k, found in enumerate(library.encode_batch(words, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == found.ids, words[k]


def test_units_beyond_the_kept_ones(monkeypatch):
    monkeypatch.setattr(tokenfile, "KEPT_UNITS", 5)
    units, library = tokenfile.UnitEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ["one two", "three four five six", "six 7 one", ""]:
        assert units.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(units.units) <= 5


def test_encoder_takes_the_shares_that_the_decoder_sees():
    pick, lanes = np.random.default_rng(4), 7
    model = coder.Model(lanes)
    for _ in range(300):
        now = pick.zipf(1.5, lanes) % 65_535
        near, tops = model.look(), now.astype(np.int32) >> coder._SHIFTS
        rows = np.stack([model.rows(k, tops[k] >> 4) for k in range(4)])
        shares = [model.mixed(rows[k], k, tops[k] >> 4, near)[0] for k in range(4)]
        before, own, total, used = model.spans(rows, tops >> 4, tops, near)
        for k, lane in np.ndindex(4, lanes):
            digit = tops[k, lane] & 15
            assert own[k, lane] == shares[k][lane, digit]
            assert before[k, lane] == shares[k][lane, :digit].sum() and total[k, lane] == shares[k][lane].sum()
        model.learn(*used)
        model.step(now)


def test_lanes_are_filled_across_batches(monkeypatch):
    monkeypatch.setattr(coder, "LANES", 8)
    whole = pa.RecordBatch.from_arrays([pa.array(range(37))], ["block"])
    cuts = [0, 3, 3, 10, 11, 30, 37]
    got = list(tokenfile._filled(whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])))
    assert [b.num_rows for b in got] == [8, 8, 8, 8, 5]
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(37))
    assert list(tokenfile._filled(iter([whole.slice(0, 0)]))) == []
