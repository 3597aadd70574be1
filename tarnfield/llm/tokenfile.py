"""Operator 8, token ids in binary blocks, written and read back.

Texts go to ascending order of their ids by a range partition, a sorted task per
part. Each text is encoded by the tokenizers library, an end id is appended, and
the ids of a part are cut into blocks of ``coder.BLOCK_IDS``; a long document runs
on over blocks. A block is coded for itself and stored with its checksum as one
record of a Parquet file: the part, the block's place, the ordinal of its first
document, its number of ids, and the bytes whose format ``coder`` describes.

The tokenizer drops white space, and no word reaches over a space; so texts are cut
at spaces and line feeds, units are looked up, and the library encodes those not
met before, whole. Units that are plain words go to it as one text, whose ids are
parted where words end. A Python worker keeps the first KEPT_UNITS units.

Reading needs no order of blocks: where a document begins follows from its block's
place and the sizes of the parts before, and the checksums of a document's pieces
are joined by the rule for appended bytes.

Defined results: a null or empty text has the end id alone; null ids come first;
rows of equal id are ordered by a hash of the text, and then any; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnfield.llm import coder
from tarnfield.llm.bpe import ragged
from tarnfield.llm.common import shared_dir, slices, stored, worker_state
from tarnfield.sources import read_table

KEPT_UNITS = 250_000
#: Letters that no normalization splits, joins or turns into marks, and ASCII's marks: the tokenizer makes a
#: word of a run of either. Units of any other kind are as right, but cost more.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-įı-ſЀ-ҁ]", r"[!-/:-@\[-`{-~]"
END_ID = 2

#: Pieces that a task hands on at once; a block has up to BLOCK_IDS more.
PIECES = 20_000

BLOCKS = "part int, block bigint, first_doc bigint, n_ids bigint, data binary"


class UnitEncoder:
    """Ids of texts by the tokenizers library, unit by unit."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.units = pa.array([""], pa.large_string())
        self.flat, self.lengths = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in a row, and how many each has."""
        found = [e.ids for e in self.library.encode_batch_fast(units.to_pylist(), add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _plain(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for units of LETTERS and at most one run of MARKS after them, as one text."""
        (found,) = self.library.encode_batch_fast([" ".join(units.to_pylist())], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        words = 1 + pc.match_substring_regex(units, f"{MARKS}$").to_numpy(zero_copy_only=False)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != words.sum():  # a vocabulary that does not mark the ends of words
            return self._each(units)
        return ids, np.diff(stops[np.cumsum(words) - 1], prepend=0)

    def _learned(self, units: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Units in another order, with their ids and how many each has."""
        plain = pc.match_substring_regex(units, f"^{LETTERS}+{MARKS}*$")
        both = units.filter(plain), units.filter(pc.invert(plain))
        (ids, lengths), (more, others) = self._plain(both[0]), self._each(both[1])
        return pa.concat_arrays(both), np.concatenate([ids, more]), np.concatenate([lengths, others])

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with ``end`` appended, and the bounds of each text's."""
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        counts = np.cumsum(np.append(0, pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False)))
        found = split.flatten().dictionary_encode()
        units, flat, lengths = self.units, self.flat, self.lengths
        codes = pc.index_in(found.dictionary, units)
        if codes.null_count:
            new, ids, sizes = self._learned(found.dictionary.filter(codes.is_null()))
            units, flat, lengths = pa.concat_arrays([units, new]), np.concatenate([flat, ids]), np.concatenate([lengths, sizes])
            codes = pc.coalesce(codes, pc.add(pc.index_in(found.dictionary, new), len(self.units)))
            if len(units) <= KEPT_UNITS:
                self.units, self.flat, self.lengths = units, flat, lengths
        codes = codes.to_numpy(zero_copy_only=False)[found.indices.to_numpy(zero_copy_only=False)]
        own = lengths[codes]
        ids = flat[ragged((np.cumsum(lengths) - lengths)[codes], own)]
        bounds = np.concatenate([[0], np.cumsum(own)])[counts]
        if end is not None:
            ids = np.insert(ids, bounds[1:], end)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


def written(documents: DataFrame, path: str, spark: SparkSession, end: int = END_ID) -> DataFrame:
    """Write the ids of ``documents(doc_id, text)`` to the shared folder; gives the blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        units = state.setdefault(("units", path), None) or UnitEncoder(path)
        state["units", path] = units
        part, block, doc = TaskContext.get().partitionId(), 0, 0
        ids, entries = [], []  # the open block
        room, ready = coder.BLOCK_IDS, []

        def close() -> None:
            nonlocal ids, entries, room
            ready.append((doc - len(entries) + 1, np.concatenate(ids), np.array(entries, coder.ENTRY)))
            ids, entries, room = [], [], coder.BLOCK_IDS

        def flush() -> pa.RecordBatch:
            nonlocal block
            some = ready[: coder.LANES]
            del ready[: coder.LANES]
            data = coder.encode([(i, e) for _, i, e in some])
            columns = [
                pa.array([part] * len(some), pa.int32()),
                pa.array(range(block, block + len(some)), pa.int64()),
                pa.array([f for f, _, _ in some], pa.int64()),
                pa.array([len(i) for _, i, _ in some], pa.int64()),
                pa.array(data, pa.binary()),
            ]
            block += len(some)
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "first_doc", "n_ids", "data"])

        for whole in batches:
            for batch in slices(whole, 1):
                names = batch.column(0).to_pylist()
                flat, bounds = units.encode(batch.column(1), end)
                for name, a, b in zip(names, bounds[:-1].tolist(), bounds[1:].tolist()):
                    flags = coder.STARTS | (coder.NO_ID if name is None else 0)
                    while True:
                        take = min(room, b - a)
                        ids.append(flat[a : a + take])
                        room -= take
                        a += take
                        entries.append((name or 0, take, flags | (coder.ENDS if a == b else 0)))
                        flags &= ~coder.STARTS
                        if not room:
                            close()
                        if a == b:
                            break
                    doc += 1
                while len(ready) >= coder.LANES:
                    yield flush()
        if ids:
            doc -= 1
            close()
        if ready:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spread = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id"), spread).sortWithinPartitions(F.col("doc_id"), spread)
    return stored(ordered.mapInArrow(task, BLOCKS), spark)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same blocks by LANES, the last ones apart, as fewer cost the coder more each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= coder.LANES:
            some = pa.concat_batches(held)
            full = some.num_rows - some.num_rows % coder.LANES
            for a in range(0, full, coder.LANES):
                yield some.slice(a, coder.LANES)
            held = [some.slice(full)]
    if any(b.num_rows for b in held):
        yield pa.concat_batches(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every document entry of every block its place, length and checksum."""
    names = ["part", "doc", "block", "doc_id", "at", "n", "crc"]
    out: list[tuple] = []

    def close() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(zip(*out))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for some in _filled(batches):
        part, block, first = (some.column(c).to_pylist() for c in ("part", "block", "first_doc"))
        for k, (ids, docs) in enumerate(coder.decode(some.column("data").to_pylist())):
            data = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(docs["n"].astype(np.int64)).tolist()
            for j, (name, n, flags) in enumerate(docs.tolist()):
                start = ends[j] - n
                crc = zlib.crc32(data[4 * start : 4 * ends[j]])
                out.append((part[k], first[k] + j, block[k], None if flags & coder.NO_ID else name, block[k] * coder.BLOCK_IDS + start, n, crc))
            if len(out) >= PIECES:
                yield close()
        if out:
            yield close()


def appended(first: int, second: int, size: int) -> int:
    """Checksum of two runs of bytes from theirs, and the size of the second."""
    nothing = bytes(size)
    return zlib.crc32(nothing, first) ^ zlib.crc32(nothing) ^ second


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs, counts = [], []
        for pieces in batch.column("pieces").to_pylist():
            crc, n = pieces[0]["crc"], pieces[0]["n"]
            for p in pieces[1:]:
                crc, n = appended(crc, p["crc"], 4 * p["n"]), n + p["n"]
            crcs.append(crc)
            counts.append(n)
        columns = [batch.column("doc_id"), batch.column("part"), batch.column("at"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def read_back(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in ``blocks``."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    pieces = blocks.mapInArrow(_pieces, "part int, doc bigint, block bigint, doc_id bigint, at bigint, n bigint, crc bigint")
    docs = pieces.groupBy("part", "doc").agg(
        F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces")
    )
    docs = docs.mapInArrow(_joined, "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(parts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of the ids of every row of ``documents``, from the files."""
    import public_tokenizers

    shared_dir(spark)
    return read_back(written(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), spark))
