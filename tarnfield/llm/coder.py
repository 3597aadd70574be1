"""An adaptive context-mixing range coder for blocks of token ids.

Each block starts from nothing and is coded for itself, so blocks can be read in
any order and a damaged one harms no other. An id is coded as four hexadecimal digits.
The probabilities of each digit are mixed from three models: order 0 counts digits after
the digits above them (the last after a hash of those); orders 1 and 2 count ids after
the last id and after the last two, the two latest ids of a context, and give to each
digit the part of those ids that agree with the digits above and have it. The weights of
the mixture are kept for each digit and for how often orders 1 and 2 have met such ids;
each model gains by its part in the probability of the digit that came.

Blocks of a task are coded side by side: every step takes one id of each block, so
all arithmetic runs over arrays. A block of n ids with documents d is stored as

    4 bytes  b"TKC2"
    u32      n                 u32  number of documents in the block
    u32      crc32 of the ids as little-endian unsigned 32-bit integers
    u32      number of 16-bit words of the payload
    for each document: i64 id, u32 ids in this block, u32 flags
             (1: it starts here, 2: it ends here, 4: its id is null)
    payload  16-bit words, the high ones of the interval first

with all numbers little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, HEAD, ENTRY = b"TKC2", "<4sIIII", np.dtype([("doc", "<i8"), ("n", "<u4"), ("flags", "<u4")])
STARTS, ENDS, NO_ID = 1, 2, 4

BLOCK_IDS = 4096
LANES = 1024
#: Rows of counts of the last digit, found by a hash of the digits above it.
LAST_ROWS = 2048
ROWS = 273 + LAST_ROWS
#: Contexts of orders 1 and 2 that a lane holds.
SLOTS = (2048, 4096)
#: What a count of order 0 gains, by digit: more under longer prefixes, which meet fewer. It begins at 1,
#: and a block is too short to take one past 16 bits.
STEPS = (2, 4, 8, 15)
#: Sum of a mixture, and the weights at first: of order 0, and for each time that order 1 or 2 has met its ids.
SCALE, START = np.float32(1 << 15), (8.0, 1.0, 2.0)
#: Before the first id of a block.
NONE = 65_535

_UP_TO = np.triu(np.ones((16, 16), np.float32))  # column d: sum of counts up to digit d
_ALL = np.ones(16, np.float32)
_DIGITS = np.arange(4, dtype=np.int32)[:, None]
_SHIFTS, _STEPS = 12 - 4 * _DIGITS, np.array(STEPS, np.uint16)[:, None]
_WORD, _REST, _FULL = np.uint64(16), np.uint64(48), np.uint64(1 << 48)
_FIRST = (0, 1, 17, 273)
_FIRSTS = np.array(_FIRST)[:, None]
_MASKS, _AFTER = np.array(SLOTS)[:, None] - 1, np.array([0, 40_503_000_017])[:, None]
_PAIR, _ID = (1 << 56) - 1, (1 << 28) - 1


def _start() -> np.ndarray:
    """Weights of the orders at first, by digit, met by order 2, met by order 1."""
    weights = np.zeros((4, 4, 4, 3), np.float32)
    weights[..., 0] = START[0]
    weights[..., 1] = START[1] * np.arange(4)
    weights[..., 2] = START[2] * np.arange(4)[:, None]
    return weights.reshape(64, 3)


class Model:
    """Predictions for many blocks, one lane each; encoder and decoder keep it alike.

    A context of order 1 or 2 is one number: the id met last after it in 16 bits and
    its count in 12, the id met before that and its count, and 7 bits that tell contexts
    of the same slot apart. Shares are whole numbers, and what they are made from comes
    from one operation after another on each element, so both sides get the same on any
    machine. Arrays have a column for each lane; the encoder's have a row for each digit.
    """

    def __init__(self, lanes: int):
        self.counts = np.ones((lanes * ROWS, 16), np.uint16)
        self.flat = self.counts.reshape(-1)
        self.contexts = np.zeros(lanes * sum(SLOTS), np.int64)
        self.weights = np.tile(_start(), (lanes, 1)).reshape(-1)
        self.orders = [self.weights[k:] for k in range(3)]
        self.bases = np.stack([np.arange(lanes) * SLOTS[0], lanes * SLOTS[0] + np.arange(lanes) * SLOTS[1]])
        self.last = np.full(lanes, NONE, np.int64)
        self.before = self.last
        self.keep(lanes)

    def keep(self, lanes: int) -> None:
        """Go on with the first lanes only."""
        lane = np.arange(lanes)
        self.row, self.weight, self.line = lane * ROWS, lane * 64, lane * 16
        self.base = self.bases[:, :lanes]
        self.last, self.before = self.last[:lanes], self.before[:lanes]

    def look(self) -> np.ndarray:
        """The ids that orders 1 and 2 have met after the last ids, two each, and their counts."""
        h = self.last * 2_654_435_761 + self.before * _AFTER
        self.slots, self.tags = self.base + (h >> 13 & _MASKS), h >> 27 & 0x7F
        held = self.contexts.take(self.slots)
        self.held = held = (held & _PAIR) * (held >> 56 == self.tags)
        near = np.empty((2, 2, 2, len(self.last)), np.int32)  # order, latest or one before, id and count
        near[:, 0, 0] = held >> 12 & 0xFFFF
        near[:, 0, 1] = held & 0xFFF
        near[:, 1, 0] = held >> 40
        near[:, 1, 1] = held >> 28 & 0xFFF
        return near.reshape(4, 2, -1)

    def rows(self, digit: int, above: np.ndarray) -> np.ndarray:
        """Rows of order 0's counts of a digit, after the digits above it."""
        return self.row + _FIRST[digit] + (above if digit < 3 else above * 40_503 >> 4 & LAST_ROWS - 1)

    def parts(self, rows: np.ndarray, digit: np.ndarray | int, above: np.ndarray, near: np.ndarray) -> tuple:
        """What order 0 gives to the 16 digits, what each id met before gives, the digits up to this of those ids, and the counts and weights used."""
        ids, times = (near[:, k] if rows.ndim == 1 else near[:, k, None] for k in (0, 1))
        top = ids >> 12 - 4 * digit
        met = times.astype(np.float32) * (top >> 4 == above).astype(np.float32)
        sums = met[::2] + met[1::2]
        few = np.minimum(sums, 3)
        at = (self.weight + 16 * digit + (few[1] * 4 + few[0]).astype(np.int64)) * 3
        own = [w.take(at) for w in self.orders]
        scale = SCALE / (own[0] + own[1] + own[2])
        seen = self.counts.take(rows, 0)
        counts = seen.astype(np.float32)
        counts *= (scale * own[0] / (counts @ _ALL))[..., None]
        np.maximum(sums, 1, out=sums)
        for k in range(2):
            met[2 * k : 2 * k + 2] *= scale * own[k + 1] / sums[k]
        return counts, met, top, (seen, at, *own)

    def mixed(self, rows: np.ndarray, digit: int, above: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Whole shares of the 16 digits, mixed from the three orders, and the parts they are made from."""
        used = counts, met, top, _ = self.parts(rows, digit, above, near)
        shares = np.floor(counts)
        shares += 1
        np.add.at(shares.reshape(-1), (self.line + (top & 15)).reshape(-1), np.floor(met).reshape(-1))
        return shares, used

    def spans(self, rows: np.ndarray, above: np.ndarray, now: np.ndarray, near: np.ndarray) -> tuple:
        """Of the shares of all four digits: those before the digit that comes, its own and all; and what ``learn`` needs."""
        counts, met, top, (seen, *weights) = self.parts(rows, _DIGITS, above, near)
        digits = now & 15
        spot = np.arange(0, 16 * rows.size, 16).reshape(rows.shape) + digits
        first = counts.reshape(-1).take(spot)
        np.floor(counts, out=counts)
        sums = counts @ _UP_TO
        hit = met * (top == now).astype(np.float32)
        gain = first, hit[0] + hit[1], hit[2] + hit[3]
        own = np.floor(first)
        np.floor(met, out=met)
        total = sums[..., -1] + met.sum(0) + 16
        met *= (top < now).astype(np.float32)
        before = sums.reshape(-1).take(spot) - own + digits.astype(np.float32) + met.sum(0)
        own += np.floor(hit, out=hit).sum(0) + 1
        return before, own, total, (rows * 16 + digits, seen.reshape(-1).take(spot), weights, gain)

    def learn(self, spots: np.ndarray, seen: np.ndarray, weights: tuple, gain: tuple) -> None:
        """Count the four digits, of which each count was ``seen``, and give weight to each order by its part in their shares."""
        at, *own = weights
        rate = 1 / (gain[0] + gain[1] + gain[2])
        for w, old, g in zip(self.orders, own, gain):
            w[at] = old + g * rate
        self.flat[spots] = seen + _STEPS

    def step(self, ids: np.ndarray) -> None:
        """Count the ids after the last ones, and go on to them."""
        held = self.held
        second = held >> 28
        front = np.where(second >> 12 == ids, second + 1, ids << 12 | 1)
        self.contexts[self.slots] = self.tags << 56 | np.where(held >> 12 & 0xFFFF == ids, held + 1, front | (held & _ID) << 28)
        self.before, self.last = self.last, ids


class Writer:
    """Narrows the interval of every lane and writes its settled words.

    An interval is its start, of 64 bits, and its width, at least 2^48 when settled.
    A step divides the width by at most 2^16; after two it is settled again, by words
    of 16 bits that leave. What a start gains beyond 64 bits is carried into the
    words, at the end.
    """

    def __init__(self, lanes: int, ids: int):
        self.low = np.zeros(lanes, np.uint64)
        self.width = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
        self.words = np.zeros((lanes, 5 * ids + 6), np.uint32)  # one word of room before the first
        self.flat = self.words.reshape(-1)
        self.at = np.arange(lanes) * self.words.shape[1] + 1

    def put(self, lanes: int, *steps: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """One or two steps of the first lanes, each the shares before the digit, its own and all."""
        low, width = self.low[:lanes], self.width[:lanes]
        start = low.copy()
        for before, count, total in steps:  # all of them add less than the width
            part = width // total
            low += part * before
            width = part * count
        carry = np.flatnonzero(low < start)
        if len(carry):
            self.flat[self.at[carry] - 1] += np.uint32(1)
        full = np.flatnonzero(width < _FULL)
        while len(full):
            at = self.at[full]
            self.flat[at] = low[full] >> _REST
            self.at[full] = at + 1
            low[full] <<= _WORD
            wide = width[full] << _WORD
            width[full] = wide
            full = full[wide < _FULL]
        self.width[:lanes] = width

    def close(self) -> list[bytes]:
        out = []
        for lane, at in enumerate(self.at):
            tail = [int(self.low[lane]) >> k & 0xFFFF for k in (48, 32, 16, 0)]
            words = np.append(self.words[lane][1 : at - lane * self.words.shape[1]], np.array(tail, np.uint32))
            while (over := words >> 16).any():
                words &= 0xFFFF
                words[:-1] += over[1:]
            out.append(words.astype("<u2").tobytes())
        return out


class Reader:
    """Follows the writer: keeps how far the code lies above the start of the interval."""

    def __init__(self, payloads: list[bytes]):
        words = [np.frombuffer(p, "<u2") for p in payloads]
        self.words = np.zeros((len(words), max(map(len, words)) + 6), np.uint16)
        for k, w in enumerate(words):
            self.words[k, : len(w)] = w
        self.flat = self.words.reshape(-1)
        self.above = np.zeros(len(words), np.uint64)
        for k in range(4):
            self.above = self.above << _WORD | self.words[:, k].astype(np.uint64)
        self.at = np.arange(len(words)) * self.words.shape[1] + 4
        self.end = self.at + self.words.shape[1] - 5
        self.width = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)

    def open(self, lanes: int) -> None:
        self.far, self.wide = self.above[:lanes], self.width[:lanes]

    def get(self, shares: np.ndarray) -> np.ndarray:
        """The digit of each open lane under its row of shares."""
        sums = shares @ _UP_TO
        part = self.wide // sums[:, -1].astype(np.uint64)
        target = (self.far // part).astype(np.float32)
        below = np.bitwise_count((sums <= target[:, None]).view(np.uint64))
        # a broken block may point beyond the last digit
        found = np.minimum((below[:, 0] + below[:, 1]).astype(np.int64), 15)
        spot = np.arange(0, shares.size, 16) + found
        own = shares.reshape(-1).take(spot)
        self.far = self.far - part * (sums.reshape(-1).take(spot) - own).astype(np.uint64)
        self.wide = part * own.astype(np.uint64)
        return found

    def settle(self) -> None:
        far, wide = self.far, self.wide
        low = np.flatnonzero(wide < _FULL)
        while len(low):
            at = self.at[low]
            far[low] = far[low] << _WORD | self.flat[np.minimum(at, self.end[low])].astype(np.uint64)
            self.at[low] = at + 1
            more = wide[low] << _WORD
            wide[low] = more
            low = low[more < _FULL]
        self.above[: len(far)], self.width[: len(far)] = far, wide


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks of falling length."""
    lengths = np.array([len(b) for b in blocks])
    ids = np.zeros((lengths[0], len(blocks)), np.int64)
    for k, b in enumerate(blocks):
        ids[: len(b), k] = b
    model, out, lanes = Model(len(blocks)), Writer(len(blocks), int(lengths[0])), len(blocks)
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    for step, n in enumerate(live.tolist()):
        if n < lanes:
            model.keep(lanes := n)
        now = ids[step, :n]
        tops = now.astype(np.int32) >> _SHIFTS
        above = tops >> 4
        rows = model.row + _FIRSTS + above
        rows[3] = model.rows(3, above[3])
        before, own, total, used = model.spans(rows, above, tops, model.look())
        steps = list(zip(*(x.astype(np.uint64) for x in (before, own, total))))
        out.put(n, *steps[:2])
        out.put(n, *steps[2:])
        model.learn(*used)
        model.step(now)
    return out.close()


def _decode(payloads: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    """Ids of payloads, by falling number of ids."""
    ids = np.zeros((int(lengths[0]), len(payloads)), np.int64)
    model, source, lanes = Model(len(payloads)), Reader(payloads), len(payloads)
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")
    for step, n in enumerate(live.tolist()):
        if n < lanes:
            model.keep(lanes := n)
        now, near = np.zeros(n, np.int32), model.look()
        spots, at, seen = np.empty((4, n), np.int64), np.empty((4, n), np.int64), np.empty((4, n), np.uint16)
        own, gain = np.empty((3, 4, n), np.float32), np.empty((3, 4, n), np.float32)
        for k in range(4):
            if k % 2 == 0:
                source.open(n)
            rows = model.rows(k, now)
            shares, (counts, met, top, (held, at[k], own[0, k], own[1, k], own[2, k])) = model.mixed(rows, k, now, near)
            digit = source.get(shares)
            now = now << 4 | digit.astype(np.int32)
            spot = model.line + digit
            spots[k], seen[k], gain[0, k] = rows * 16 + digit, held.reshape(-1).take(spot), counts.reshape(-1).take(spot)
            hit = met * (top == now).astype(np.float32)
            np.add(hit[::2], hit[1::2], out=gain[1:, k])
            if k % 2:
                source.settle()
        model.learn(spots, seen, (at, *own), gain)  # only now, as the encoder sees all four digits at once
        ids[step, :n] = now
        model.step(ids[step, :n])
    return [ids[:n, k] for k, n in enumerate(lengths)]


def _even(order: list[int]) -> list[list[int]]:
    """Cut into groups of at most LANES, about equal ones."""
    n = -(-len(order) // LANES)
    cuts = [len(order) * k // max(1, n) for k in range(n + 1)]
    return [order[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """Stored form of blocks, each its ids (at most BLOCK_IDS, under 65535) and its document entries."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k][0]))
    for group in _even(order):
        payloads = _encode([blocks[k][0] for k in group]) if len(blocks[group[0]][0]) else [b""] * len(group)
        for k, payload in zip(group, payloads):
            ids, docs = blocks[k]
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            out[k] = struct.pack(HEAD, MAGIC, len(ids), len(docs), crc, len(payload) // 2) + docs.astype(ENTRY).tobytes() + payload
    return out


def decode(stored: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and document entries of stored blocks; raises where a checksum differs."""
    heads = [struct.unpack_from(HEAD, s) for s in stored]
    if any(h[0] != MAGIC for h in heads):
        raise ValueError("not a block of token ids")
    docs = [np.frombuffer(s, ENTRY, h[2], struct.calcsize(HEAD)) for s, h in zip(stored, heads)]
    out: list = [None] * len(stored)
    order = sorted(range(len(stored)), key=lambda k: -heads[k][1])
    for group in _even(order):
        payloads = [stored[k][struct.calcsize(HEAD) + docs[k].nbytes :][: 2 * heads[k][4]] for k in group]
        lengths = np.array([heads[k][1] for k in group])
        for k, ids in zip(group, _decode(payloads, lengths) if lengths[0] else [np.empty(0, np.int64)] * len(group)):
            if zlib.crc32(ids.astype("<u4").tobytes()) != heads[k][3]:
                raise ValueError("checksum of a block of token ids differs")
            out[k] = ids, docs[k]
    return out
