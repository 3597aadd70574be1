"""Operator 2, secrets: fixed patterns, and guess costs of values in credential contexts.

A value that follows a word for a credential (``password is ...``, ``pwd: ...``,
``://user:...@``) may be a placeholder or a real secret. Its guess cost decides:
the cheapest way to cut it into parts, each guessed on its own, found by dynamic
programming over its ends. Parts are words of the corpus (cost: one over their
share of all words, more for capitals and for digits that stand for letters),
dates, repeats, keyboard walks, and single characters by brute force. A repeat is the
shortest unit before it once or more again, any unit and three or more in all; it costs
their number, as the unit before it has been guessed by its own parts. A walk is any
stretch of four or more neighbouring keys, or letters in alphabetical order. A value
that costs ``least`` guesses or more, as a power of ten, is a secret and gets a span of
its own, also where it lies inside a span of the base patterns, which stays.

Word counts are taken over all texts but for the values themselves, which would make a
secret of letters a known word, and only of words that occur inside a value:
a filter of fixed size goes to the tasks, and an exact join follows. Words of more than
KEY letters are looked for by their first KEY and compared when the value is cut.

Defined results: a null or empty text has no spans; a text of any length is read
whole; so is a value, in time about linear in its length, with words, repeats and walks
of any length; equal values are judged once; repeated rows and null ids come back row
by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import bitmap, salted_join, slices, span_hashes, stored
from tarnfield.llm.langid import Words
from tarnfield.sources import read_table

KINDS = ("assign", "access", "hex", "guess")
#: Power of ten of the guesses that a secret costs at least.
LEAST = 8.0
SHORTEST, KEY = 3, 20
FILTER = 1 << 20
#: Places of a value whose words a task gives out at once.
INNER = 4096
#: Periods that are looked for by comparing a value with itself moved along.
NEAR = 63

# The base patterns, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Words for credentials in several languages, and what stands between them and a value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wort|wd|phrase|code|key)?|kennwort|pwd|contraseña|clave|mot\x20de\x20passe|secret|token|credentials?"""
    r"""|(?:api|access|private|secret|encryption)[\x20_-]?key|auth(?:orization)?|login|bearer)(?:[_-][a-z0-9]{1,20})?["'`]?"""
    r"""(?:\x20{0,3}(?::=|=>|[:=])\x20{0,3}|\x20(?:is|ist|es|est|lautet|was):?\x20)["'`]?([^\s"'`<>]{4,})"""
    r"""|://[^\s/:@"'<>]{1,64}:([^\s/@"'<>]{4,})@""",
    re.I,
)
STEMS = ("pass", "kennwort", "pwd", "contrase", "clave", "secret", "token", "credential", "key", "auth", "login", "bearer", "://")
BASE_STEMS = ("password", "passwd", "secret", "token", "api")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = {"4": "a", "@": "a", "3": "e", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "1": "i", "!": "i", "|": "l"}

_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])}
_NEXT |= {(a, b) for up, down in zip(ROWS, ROWS[1:]) for k, a in enumerate(up) for b in down[max(0, k - 1) : k + 1]}
_NEXT |= {(b, a) for a, b in _NEXT} | {(c, c) for row in ROWS for c in row}
_ORDER = {pair for k in range(ord("a"), ord("z")) for pair in ((chr(k), chr(k + 1)), (chr(k + 1), chr(k)))}
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9][0-9]"
# Forms of dates, and how many dates each can be.
DATES = tuple(
    (re.compile("[-/._]?".join(form)), math.log10(dates))
    for form, dates in (
        ((_YEAR,), 120),
        ((_YEAR, _MONTH), 120 * 12),
        ((_YEAR, _MONTH, _DAY), 120 * 366),
        ((_DAY, _MONTH), 366),
        ((_DAY, _MONTH, _YEAR), 120 * 366),
        ((_DAY, _MONTH, "[0-9][0-9]"), 120 * 366),
    )
)
_END = ".,;:!?)]}…”»"


def forms(value: str) -> list[str]:
    """The value in lower case, and with its digits and signs read as letters if few."""
    small = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    odd = sum(c in LEET for c in small)
    return [small] if not odd or 3 * odd > len(small) else [small, "".join(LEET.get(c, c) for c in small)]


def inner_words(value: str) -> Iterator[set[str]]:
    """All runs of SHORTEST to KEY letters inside the forms of a value, those of INNER places at a time."""
    for form in forms(value):
        for first in range(0, len(form), INNER):
            out = set()
            for start in range(first, min(len(form), first + INNER)):
                for end in range(start + 1, min(len(form), start + KEY) + 1):
                    if not form[end - 1].isalpha():
                        break
                    if end - start >= SHORTEST:
                        out.add(form[start:end])
            yield out


def _single(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _row(c: str) -> int:
    """The keyboard row of a key."""
    return next((k for k, row in enumerate(ROWS) if c in row), -1)


def _alike(text: str, a: int, b: int, way: int) -> int:
    """How many characters agree from places a < b on, forwards (way 1), or before them, backwards (-1)."""
    room, size, step, growing = len(text) - b if way > 0 else a, 0, 64, True
    while size < room:
        m = min(step, room - size)
        x, y = (a + size, b + size) if way > 0 else (a - size - m, b - size - m)
        if text[x : x + m] == text[y : y + m]:
            size += m
            step = 2 * step if growing else max(1, step // 2)
        elif m == 1:
            break
        else:
            step, growing = m // 2, False
    return size


def runs(text: str) -> list[tuple[int, int, int]]:
    """Start, end and shortest period of the longest stretches with three periods or more."""
    n, found, ends = len(text), [], set()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")

    def add(start: int, end: int, period: int) -> None:
        if (start, end) not in ends:  # a longer period of the same stretch is a multiple of its shortest
            ends.add((start, end))
            found.append((start, end, period))

    for period in range(1, min(n // 3, NEAR) + 1):
        cuts = np.concatenate([[-1], np.flatnonzero(points[period:] != points[:-period]), [n - period]])
        for k in np.flatnonzero(np.diff(cuts) - 1 >= 2 * period).tolist():
            add(int(cuts[k]) + 1, int(cuts[k + 1]) + period, period)
    # periods of width to 2 * width: a block that every such run holds, and where it stands again
    width = NEAR + 1
    while 3 * width <= n:
        shorter, at, reach, last = sorted(found), 0, 0, {}
        for a in range(0, n - 2 * width + 1, width):
            while at < len(shorter) and shorter[at][0] <= a:
                reach = max(reach, shorter[at][1])
                at += 1
            if reach >= a + 3 * width:
                continue  # what repeats here has a shorter period
            block = text[a : a + width]
            again = text.find(block, a + width, a + 3 * width - 1)
            while again >= 0:
                period = again - a
                if last.get(period, 0) < again + width:
                    start, end = a - _alike(text, a, again, -1), again + _alike(text, a, again, 1)
                    last[period] = end
                    if end - start >= 3 * period:
                        add(start, end, period)
                again = text.find(block, again + 1, a + 3 * width - 1)
        width *= 2
    return found


def _least(kept: list[tuple[int, float]], start: int, weight: float, end: int) -> float:
    """The least of weight + log10(end - start) over the starts so far and one more, further on.

    A later start of no more weight is better at every end; an earlier one that is better
    at one end is so at all that follow. So few are kept.
    """
    while kept and kept[-1][1] >= weight:
        kept.pop()
    kept.append((start, weight))
    low, left = math.inf, []
    for s, w in kept:
        cost = w + math.log10(end - s)
        if cost < low:
            low = cost
            left.append((s, w))
    kept[:] = left
    return low


def guess_cost(value: str, words: dict[str, float]) -> float:
    """Power of ten of the guesses for a value; ``words`` has the power of ten of each inner word."""
    n, all_forms = len(value), forms(value)
    small = all_forms[0]
    parts: dict[int, list[tuple[int, float]]] = {}  # by end: start and cost
    long: dict[str, list[str]] = {}
    for word in words:
        if len(word) > KEY:
            long.setdefault(word[:KEY], []).append(word)
    sizes = sorted({len(w) for w in words if len(w) <= KEY})
    for nth, form in enumerate(all_forms):
        for start in range(n if words else 0):
            held = [w for size in sizes if (w := form[start : start + size]) in words and len(w) == size]
            held += [w for w in long.get(form[start : start + KEY], ()) if form.startswith(w, start)]
            for word in held:
                end = start + len(word)
                plain = value[start:end]
                upper = sum(c.isupper() for c in plain)
                capitals = 0.0 if not upper else math.log10(2) if upper == len(plain) or (upper == 1 and plain[0].isupper()) else math.log10(math.comb(len(plain), upper) + 1)
                signs = sum(a != b for a, b in zip(word, small[start:end])) if nth else 0
                parts.setdefault(end, []).append((start, words[word] + capitals + signs * math.log10(2)))
    for start in range(n):
        for form, cost in DATES if value[start].isdigit() else ():
            if m := form.match(value, start):
                parts.setdefault(m.end(), []).append((start, cost))
    coming = sorted(((start + 3 * period, end, period) for start, end, period in runs(value)), reverse=True)
    going: list[tuple[int, int, dict[int, list[tuple[int, float]]]]] = []  # end, period and starts of the runs here
    rows, turn, turns = [_row(c) for c in small], math.log10(4), [0] * (n + 1)  # changes of row up to each key
    walk, walks, order, orders = 0, [], 0, []  # where the walk and the alphabetical stretch begin, and starts in them
    best = [0.0] * (n + 1)
    for end in range(1, n + 1):
        low = best[end - 1] + _single(value[end - 1])
        for start, cost in parts.get(end, ()):
            low = min(low, best[start] + cost + math.log10(2))
        key = end - 1
        if key:
            turns[key] = turns[key - 1] + (rows[key] != rows[key - 1])
            if (small[key - 1], small[key]) not in _NEXT:
                walk, walks = key, []
            if (small[key - 1], small[key]) not in _ORDER:
                order, orders = key, []
        if end - order >= 4:
            low = min(low, _least(orders, end - 4, best[end - 4], end) + math.log10(26))
        if end - walk >= 4:
            low = min(low, _least(walks, end - 4, best[end - 4] - turn * turns[end - 4], end) + math.log10(94) + turn * turns[key])
        while coming and coming[-1][0] <= end:
            _, last, period = coming.pop()
            going.append((last, period, {}))
        if going:
            going = [x for x in going if x[0] >= end]
            for _, period, starts in going:  # the unit stands before the repeat, so the stretch starts one period earlier
                low = min(low, _least(starts.setdefault(end % period, []), end - 3 * period, best[end - 2 * period], end) - math.log10(period))
        best[end] = low
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    small = text.lower()
    if any(s in small for s in BASE_STEMS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(out)


def values(text: str) -> list[tuple[int, int, str]]:
    """Start, end and text of the values in credential contexts."""
    small, out = text.lower(), []
    if any(s in small for s in STEMS):
        for m in CONTEXT.finditer(text):
            group = 1 if m[1] is not None else 2
            value = m[group].rstrip(_END)
            if len(value) >= 4:
                out.append((m.start(group), m.start(group) + len(value), value))
    return out


def without_values(text: str) -> str:
    """The text with a space for each value in a credential context."""
    out, at = [], 0
    for start, end, _ in values(text):
        out += [text[at:start], " "]
        at = end
    return "".join(out) + text[at:] if out else text


FOUND = "doc_id bigint, row_key bigint, base array<struct<start:bigint,kind:int,end:bigint>>, vals array<struct<start:bigint,end:bigint,value:string>>"
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_VALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2):
            base, vals = [], []
            for text in batch.column(2).to_pylist():
                own = base_spans(text) if text else []
                base.append([dict(zip(("start", "kind", "end"), x)) for x in own])
                vals.append([{"start": a, "end": b, "value": v} for a, b, v in (values(text) if text else [])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, _BASE), pa.array(vals, _VALS)], ["doc_id", "row_key", "base", "vals"])


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words inside each value, which goes by its number."""
    for batch in batches:
        for nr, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for inner in inner_words(value):
                yield pa.RecordBatch.from_arrays([pa.array([nr] * len(inner), pa.int64()), pa.array(sorted(inner), pa.string())], ["nr", "word"])


def _bucket(texts: list[str]) -> np.ndarray:
    """The bucket of each text in lower case."""
    ends = 4 * np.cumsum([len(t) for t in texts])
    data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint8)
    return span_hashes(data, np.concatenate([[0], ends[:-1]]), ends) & np.uint64(FILTER - 1)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bucket(batch.column(0).to_pylist())).astype(np.int32))], ["bucket"])


def _counted(wanted: np.ndarray):
    """A task that counts the words of texts that may be wanted, and, under null, all words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                words = Words([without_values(t) for t in batch.column(0).to_pylist()])
                times = np.bincount(words.word, minlength=len(words.first))
                own = words.name & np.uint64(FILTER - 1)
                long = np.flatnonzero(np.diff(words.first, append=len(words.letters)) - 2 > KEY)
                if len(long):
                    own[long] = _bucket([words.text(k)[:KEY] for k in long])
                pick = np.flatnonzero(wanted[own])
                held = [None, *(words.text(k) for k in pick)]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([len(words.word), *times[pick].tolist()], pa.int64())], ["word", "n"])

    return task


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [guess_cost(v, {w["word"]: w["cost"] for w in known or ()}) for v, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.float64())], ["value", "cost"])


def judged(distinct: DataFrame, texts: DataFrame, spark: SparkSession) -> DataFrame:
    """``value`` and ``cost`` of the distinct values of ``distinct(value)``, by the words of ``texts(text)``."""
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("nr"), "value"), spark)
    inner = stored(distinct.mapInArrow(_inner, "nr bigint, word string"), spark)
    bits = bitmap(inner.select("word").distinct().mapInArrow(_buckets, "bucket int"), "bucket", FILTER)
    counts = stored(texts.where("text is not null").select("text").mapInArrow(_counted(bits), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), spark)
    total = counts.where("word is null").agg(F.max("n")).first()[0] or 1
    cost = F.log10(F.lit(float(total)) / F.col("n"))
    # a common inner word may be in a large part of the values
    counted = counts.where("word is not null").select(F.substring("word", 1, KEY).alias("word"), F.struct("word", cost.alias("cost")).alias("whole"))
    known = salted_join(inner, counted, ["word"], F.col("nr")).groupBy("nr").agg(F.collect_set("whole").alias("known"))
    return distinct.join(known, "nr", "left").select("value", "known").mapInArrow(_costs, "value string, cost double")


_JOIN = "concat_ws(',', transform({}, s -> concat(element_at(array('assign','access','hex','guess'), s.kind + 1), ':', s.start, ':', s.end)))"


def scanned(documents: DataFrame, spark: SparkSession, least: float = LEAST) -> DataFrame:
    """Spans of every row of ``documents(doc_id, text)``: ``base`` and ``all``, as arrays in order."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), "text")
    found = stored(rows.mapInArrow(_scan, FOUND), spark)
    each = found.select("row_key", F.explode("vals").alias("v")).select("row_key", "v.start", "v.end", "v.value")
    costs = judged(stored(each.select("value").distinct(), spark), rows, spark)
    strong = salted_join(each, costs.where(F.col("cost") >= least).select("value"), ["value"], F.col("row_key"))
    span = F.struct("start", F.lit(KINDS.index("guess")).alias("kind"), "end")
    added = strong.groupBy("row_key").agg(F.collect_set(span).alias("added"))
    out = found.join(added, "row_key", "left")
    return out.withColumn("all", F.expr("array_sort(concat(base, coalesce(added, cast(array() as array<struct<start:bigint,kind:int,end:bigint>>))))"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every row of ``documents``."""
    found = scanned(read_table(spark, sf_dir, "documents"), spark)
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        F.sha2(F.expr(_JOIN.format("base")), 256).alias("base_sha256"),
        F.expr(_JOIN.format("`all`")).alias("spans"),
    )
