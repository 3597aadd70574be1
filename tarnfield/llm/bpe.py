"""Operator 4, byte-level BPE by a depth-first walk over the trie of the distinct words.

Of an encoding, the tokens before the last are the encoding of the bytes before
the last, so a prefix needs to keep only its last token. It is the one token
that ends the prefix and may follow the last token of what stands before it: two
tokens may stand side by side if the merges turn their joined bytes into these
two again. Sorted, the distinct words are the leaves of their trie in depth-first
order: from one word to the next the walk climbs back to the shared prefix, whose
last tokens stay on the path, and goes down the rest.

A text is cut where white space starts, which no word reaches over; such units are
looked up, and only those not yet known are cut into words and walked. A Python
worker keeps the first KEPT_UNITS units it meets, so memory is bounded by that
and by the longest text.

Defined results: a null or empty text has no ids and decodes to the empty text;
strings of special tokens in a text give their ids; repeated rows and null ids
come back row by row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tarnfield.llm.common import bound_batches, slices, worker_state
from tarnfield.sources import read_table

KEPT_UNITS = 250_000
KEPT_PAIRS = 300_000
#: Bytes of text encoded at once, long texts apart; an id stands for about three.
TEXT_BYTES = 1_000_000

#: Fixed value: the pattern that splits a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class TrieBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file in JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.ranks = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks[bytes(letters[c] for c in a), bytes(letters[c] for c in b)] = rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.ids.pop(bytes(letters.get(c, 0) for c in content), None)
            assert i not in self.ids.values()
        self.tokens = {i: token for token, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.word = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.blank = regex.compile(r"\s")
        self.pairs: dict[int, bool] = {}  # by the left token's id above 32 bits, the right one's in them
        self.index: dict[str | tuple[str], int] = {}
        self.flat, self.lengths, self.starts = array("I"), array("I"), array("Q")
        known = self.tokens | {i: content.encode() for content, i in self.special.items()}
        size = max(known) + 1
        self.token_length = np.array([len(known.get(i, b"")) for i in range(size)])
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(known.get(i, b"") for i in range(size)), np.uint8)

    def _keep(self, unit: str | tuple[str], ids: list[int]) -> None:
        self.index[unit] = len(self.lengths)
        self.starts.append(len(self.flat))
        self.flat.extend(ids)
        self.lengths.append(len(ids))

    def merged(self, word: bytes) -> list[bytes]:
        """The encoding by its definition: the merge of the lowest rank first, from the left."""
        parts, rank = [word[k : k + 1] for k in range(len(word))], self.ranks.get
        while True:
            low, at = 1 << 60, -1
            for k in range(len(parts) - 1):
                own = rank((parts[k], parts[k + 1]), low)
                if own < low:
                    low, at = own, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        found = self.pairs.get(a << 32 | b)
        if found is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            first, second = self.tokens[a], self.tokens[b]
            found = self.pairs[a << 32 | b] = self.merged(first + second) == [first, second]
        return found

    def walk(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of each of the sorted words, each prefix in the trie being encoded once."""
        ids, pairs, longest = self.ids, self.pairs, self.longest
        last, size, before = [-1], [0], b""  # by depth: the last token of the prefix and its length
        for word in words:
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], size[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                # one token alone fits, so the likeliest are tried first: the last one made longer, a single byte
                guess = end - 1 - size[end - 1]
                for start in chain((guess, end - 1), range(max(0, end - longest), end - 1)):
                    token = ids.get(word[start:end])
                    if token is not None:
                        left = last[start]
                        if left < 0:
                            break
                        fits = pairs.get(left << 32 | token)
                        if fits or (fits is None and self.may_follow(left, token)):
                            break
                last.append(token)
                size.append(end - start)
            before = word
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at -= size[at]
            out.reverse()
            yield out

    def _words(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return self.word.findall(text)
        out = []
        for part in self.split.split(text):
            out.extend([part] if part in self.special else self.word.findall(part))
        return out

    def _learn(self, units: list) -> None:
        """Encode units and keep them. Words never reach over the start of white space."""
        blank, words, index = self.blank.match, self._words, self.index
        fresh, ids = [], {w: [i] for w, i in self.special.items()}
        unknown: dict[str, None] = {}
        for unit in units:
            if type(unit) is tuple:
                parts = words(unit[0])
            elif unit.isalpha():
                parts = [" " + unit]
                unknown[parts[0]] = None
            elif not unit or blank(unit[-1]):
                index[unit] = -1  # white space runs on behind it
                continue
            else:
                parts = words(unit if unit[0] == "\n" else " " + unit)
            fresh.append((unit, parts))
        for _, parts in fresh:
            for word in parts:
                if word not in ids and word not in unknown:
                    code = index.get(word[1:], -1) if word[0] == " " and word[1:].isalpha() else -1  # a unit of one word
                    if code >= 0:
                        start = self.starts[code]
                        ids[word] = self.flat[start : start + self.lengths[code]].tolist()
                    else:
                        unknown[word] = None
        order = sorted((w.encode(), w) for w in unknown)
        ids.update(zip([w for _, w in order], self.walk([b for b, _ in order])))
        for unit, parts in fresh:
            self._keep(unit, ids[parts[0]] if len(parts) == 1 else [i for w in parts for i in ids[w]])

    def _units(self, text: str) -> list:
        """Parts that are encoded apart: what stands between spaces, with the space before it.

        A unit that opens a line starts with the line feed instead, the first of
        a text with nothing, which a tuple tells.
        """
        units = text.replace("\n", " \n").split(" ")
        units[0] = (units[0],)
        return units

    def _codes(self, units: list) -> np.ndarray:
        codes = np.fromiter(map(self.index.get, units, repeat(-2)), np.int64, len(units))
        if len(codes) and codes.min() == -2:
            self._learn(list(dict.fromkeys(units[k] for k in np.flatnonzero(codes == -2))))
            codes = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        return codes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's ids."""
        kept = len(self.index), len(self.flat), len(self.lengths)
        units, counts = [], [0]
        for text in texts:
            if text:
                special = any(s in text for s in self.special)
                units += [(w,) for w in self._words(text)] if special else self._units(text)
            counts.append(len(units))
        codes = self._codes(units)
        if len(codes) and codes.min() == -1:  # a text with longer white space goes word by word
            odd = np.unique(np.searchsorted(counts, np.flatnonzero(codes == -1), "right") - 1)
            again, bounds = set(odd.tolist()), counts
            parts, counts = [], [0]
            for k, text in enumerate(texts):
                parts.append(self._codes([(w,) for w in self._words(text)]) if k in again else codes[bounds[k] : bounds[k + 1]])
                counts.append(counts[-1] + len(parts[-1]))
            codes = np.concatenate(parts)
        own = np.array(self.lengths, np.int64)[codes]
        ids = np.array(self.flat, np.uint32)[ragged(np.array(self.starts, np.int64)[codes], own)]
        if len(self.index) > KEPT_UNITS:
            self._drop(*kept)
        return ids, np.concatenate([[0], np.cumsum(own)])[counts]

    def _drop(self, units: int, ids: int, lengths: int) -> None:
        """Forget the units learned after the first so many."""
        while len(self.index) > units:
            self.index.popitem()
        del self.flat[ids:], self.lengths[lengths:], self.starts[lengths:]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8; bytes that are no UTF-8 become the replacement sign."""
        at = ragged(self.token_start[ids], self.token_length[ids])
        return self.token_bytes[at].tobytes().decode("utf-8", "replace").encode()


def _coder(path: str) -> TrieBPE:
    state = worker_state()
    if ("bpe", path) not in state:
        state["bpe", path] = TrieBPE(path)
    return state["bpe", path]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from slices(whole, whole.schema.get_field_index("text"), TEXT_BYTES)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row."""

    def task(batches):
        coder = _coder(path)
        for batch in _texts(batches):
            ids, bounds = coder.encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    bound_batches(documents.sparkSession)
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(task, "doc_id bigint, ids array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ``doc_id, ids``; null ids give the empty text."""

    def task(batches):
        coder = _coder(path)
        for batch in batches:
            texts = [coder.decode(np.array(ids or [], np.int64)).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    bound_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id bigint, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Encode every text, decode its ids, and return count and hashes of both."""

    def task(batches):
        coder = _coder(path)
        for batch in _texts(batches):
            ids, bounds = coder.encode(batch.column("text").to_pylist())
            sha_ids, sha_text = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                sha_ids.append(hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest())
                sha_text.append(hashlib.sha256(coder.decode(ids[a:b])).hexdigest())
            columns = [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(documents.sparkSession)
    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return rows.mapInArrow(task, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and hashes of the ids and of the decoded text of every row of ``documents``."""
    import public_tokenizers

    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
