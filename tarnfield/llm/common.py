"""Helpers that several operators share: stored tables, text slices, word tables.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout, the split that ``bytes.split()``
makes of UTF-8, since no other white space lies in the ASCII range.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once, long texts apart.
SLICE_BYTES = 2_000_000
BATCH_BYTES = 4 << 20
#: Parts into which the rows of a hot join key are dealt.
SALTS = 16

#: The run folder of each application of this process.
_FOLDERS: dict[str, str] = {}
#: Lists that note what is stored while they are here.
_RECORDS: list[list[str]] = []

_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def bound_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of BATCH_BYTES, long rows apart.

    The default of 64 MB, held by the JVM and by Python and taken apart there, is most
    of what a task may use. This is the one setting that the operators make.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own under ``spark.checkpoint.dir``; it goes when the application ends.

    Where the setting is absent, a local session gets a temporary folder. On a cluster
    there is no folder that could stand in for a shared one, so that is an error.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no folder; set it to one that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tarnfield-")
        folder = f"{base.rstrip('/')}/tarnfield-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[context.applicationId] = folder
    return _FOLDERS[context.applicationId]


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, for what tasks load once."""
    return sys.modules.setdefault("_tarnfield_worker", types.ModuleType("_tarnfield_worker")).__dict__


def stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage: a lost executor costs a reread, not a recomputation, and what
    is read twice is computed once. The files go when the application ends.
    """
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for paths in _RECORDS:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``stored`` writes inside the block."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS[:] = [x for x in _RECORDS if x is not paths]


def removed(paths: list[str], spark: SparkSession) -> None:
    """Delete stored files that nothing reads any more."""
    context = spark.sparkContext
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def only_last(spark: SparkSession) -> Iterator[None]:
    """Of the tables stored inside the block all but the last go when it ends."""
    with recorded() as paths:
        yield
    removed(paths[:-1], spark)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block a query's shuffle files go when it ends.

    Else they stay until the driver happens to collect its garbage, which does not
    follow from how much disk they take.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def packed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows of ``df`` as ``doc``, one struct, each with a number of its own, ``nr``; stored.

    The number is fixed once it is written, so it names a row in every later join;
    own columns stand beside ``doc`` and cannot clash with those of ``df``.
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")
    return stored(df.select(F.monotonically_increasing_id().alias("nr"), doc), spark)


def bitmap(buckets: DataFrame, column: str, size: int) -> np.ndarray:
    """Flags of the numbers below ``size``, a multiple of 2^15, that a column holds, made where the rows are.

    ``size`` bits come to the driver, whatever the number of rows.
    """
    at = F.col(column).cast("bigint")
    parts = buckets.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    out = np.zeros(size, bool)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[r.part << 15 : (r.part + 1) << 15] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    return out


def salted_join(many: DataFrame, few: DataFrame, on: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join ``many`` with ``few`` where single keys may hold a large part of ``many``.

    ``few`` has at most one row per key. It is repeated SALTS times, and
    ``spread`` (any column of ``many`` that differs between rows) deals the rows
    of a key over the repetitions.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def give_back() -> None:
    """Return to the system what this process has freed but still holds, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch, without copying, into parts of about ``most`` bytes of text.

    What a part took is given back after it, as a worker that waits for its next task
    counts with the executor like one that works.
    """
    n = batch.num_rows
    if not n:
        return
    text = batch.column(column)
    ends = np.cumsum(np.frombuffer(pc.binary_length(text.fill_null("")).cast(pa.int64()).buffers()[1], np.int64, n))
    start = 0
    while start < n:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        give_back()
        start = stop


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its rows; null is empty."""
    text = pa.concat_arrays([text.fill_null("").cast(pa.large_string())])
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``data[start:end]``, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    out = left.astype(np.uint64) * _MULT
    at, spans = starts, None  # None: all spans
    while len(at):
        got = eights[at] & _MASKS[np.minimum(left, 8)]
        if spans is None:
            out = mix(out ^ got)
            spans = np.flatnonzero(left > 8)
            at, left = at[spans] + 8, left[spans] - 8
        else:
            out[spans] = mix(out[spans] * _ODD ^ got)
            more = left > 8
            spans, at, left = spans[more], at[more] + 8, left[more] - 8
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word; ``gap`` flags the bytes between words."""
    ink = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a row, and the row's run bounds.

    A row with some words but fewer than ``size`` has one run of all its words.
    """
    n = len(hashes)
    counts = np.diff(rows)
    at = np.arange(n) - np.repeat(rows[:-1], counts)
    left = np.repeat(rows[1:], counts) - np.arange(n)
    short = left < size
    total = hashes * _ODD
    for k in range(1, size):
        step = np.zeros(n, np.uint64)
        step[: max(0, n - k)] = hashes[k:]
        step[left <= k] = 0
        total = (total ^ (total >> np.uint64(29))) * _ODD + step
    total = mix(total)
    keep = ~short | (at == 0)
    bounds = np.concatenate([[0], np.cumsum(np.where(counts > 0, np.maximum(1, counts - size + 1), 0))])
    return total[keep], bounds


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from sorted batches, one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
            change[0] = False
        else:
            change[0] = True
        cuts = np.flatnonzero(change).tolist()
        first = cuts[0] if cuts else batch.num_rows
        if first:
            held.append(batch.slice(0, first))
        for start, stop in zip(cuts, [*cuts[1:], batch.num_rows]):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(start, stop - start)]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Connected components: ``(id, component)`` for each id in ``edges(a, b)``.

    ``component`` is the smallest id reachable. Labels hook to the smallest
    label among the neighbours' and then to their label's label, which takes
    a number of rounds logarithmic in the longest path. Rounds are stored; only
    a count of changes comes to the driver. Jumps join against the labels in
    use, dealt by salt, as all of a large component share one label.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stored(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), spark)
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), spark)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("low"))
        hooked = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "component", F.least("component", "low").alias("low"))
        # what a label's followers have seen is offered to the label itself
        offers = hooked.select("id", "low").union(hooked.select(F.col("component").alias("id"), "low"))
        fresh = stored(offers.groupBy("id").agg(F.min("low").alias("low")), spark)
        used = fresh.select("low").distinct()
        roots = used.join(fresh.select(F.col("id").alias("low"), F.col("low").alias("next")), "low")
        jumped = salted_join(fresh, roots, ["low"], F.col("id")).select("id", F.least("low", "next").alias("component"))
        after = stored(jumped, spark)
        changed = after.join(labels.withColumnRenamed("component", "was"), "id").where("component <> was").limit(1).count()
        labels = after
        if not changed:
            return labels
