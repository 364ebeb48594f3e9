"""Vectorised text kernels over Arrow string columns.

Texts of a batch are looked at as one run of UTF-8 bytes.  A *word class* is a 256-entry table that says which bytes
belong to words; as every byte of a multi-byte character is >= 0x80, a class that treats those bytes alike never cuts
a character.  Words get 64-bit hashes from one prefix sum over the bytes, so no Python object is made per word.

Batches are worked through in slices of ``SLICE`` bytes, and a text longer than that in pieces cut at non-word bytes, so
memory does not follow the length of the texts (only the words' own arrays do).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: list[tuple[np.ndarray, np.ndarray]] = []  # one pair of tables at most

#: Bytes of white space: space, \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False
#: Maps A-Z to a-z and leaves all else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Digits, ASCII letters and every character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Bytes that begin a character.
CHAR_START = (np.arange(256) & 0xC0) != 0x80


def give_back() -> None:
    """Returns memory that is free to the system; workers live on between tasks, and beside others of the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that gives memory back when it is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that hashes behave as if they were random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, at least n of each."""
    if not _powers or len(_powers[0][0]) < n:
        size, out = 1 << max(10, (n - 1).bit_length()), []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            out.append(p)
        if size > 4 * SLICE:  # one very long word; not worth keeping
            return out[0], out[1]
        _powers[:] = [(out[0], out[1])]
    return _powers[0]


class SpanHasher:
    """64-bit hashes of data[starts[i]:ends[i]] for one piece of data, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _Q)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; data is one piece."""
    return SpanHasher(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


@dataclass
class Slice:
    """Some rows of a batch: the bytes of their texts, and where each text begins; row i is batch row first + i."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a slice: byte spans, hashes, and the row that each belongs to."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    row: np.ndarray
    counts: np.ndarray


def slices(texts: pa.Array) -> Iterator[Slice]:
    """Rows of a string column in slices of about SLICE bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, off, raw = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def _pieces(data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at bytes outside words; only a single huge word makes a piece larger than SLICE."""
    at = 0
    while at < len(data):
        to = min(len(data), at + SLICE)
        while to < len(data) and inside[data[to]]:
            further = np.flatnonzero(~inside[data[to : to + 65536]])
            to = to + int(further[0]) if len(further) else min(len(data), to + 65536)
        yield at, to
        at = to


def words(s: Slice, inside: np.ndarray, fold: np.ndarray | None = None, hashed: bool = True) -> Words:
    """Maximal runs of bytes of the class; fold maps bytes before they are hashed."""
    starts, ends, hashes = [], [], []
    for a, b in _pieces(s.data, inside) if len(s.data) > 2 * SLICE else [(0, len(s.data))]:
        data = s.data[a:b]
        cuts = s.offsets[(s.offsets >= a) & (s.offsets <= b)] - a
        mask = inside[data]
        begins, finishes = mask.copy(), mask.copy()
        begins[1:] &= ~mask[:-1]
        finishes[:-1] &= ~mask[1:]
        at = cuts[cuts < len(data)]
        begins[at] = mask[at]
        at = cuts[cuts > 0] - 1
        finishes[at] = mask[at]
        x, y = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        if hashed:
            hashes.append(span_hashes(data if fold is None else fold[data], x, y))
        starts.append(x + a)
        ends.append(y + a)
    join = lambda parts, kind: parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, kind), *parts])
    x = join(starts, np.int64)
    edges = np.searchsorted(x, s.offsets)
    counts = np.diff(edges)
    return Words(x, join(ends, np.int64), join(hashes, np.uint64) if hashed else np.zeros(0, np.uint64), np.repeat(np.arange(s.rows), counts), counts)


def window_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of so many consecutive words of one row, and the index of each window's first word."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(w.row[: n] == w.row[size - 1 :]) if size > 1 else np.arange(n)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * _Q + w.hashes[k : n + k]
    return mix(h[first] + np.uint64(size)), first


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return member(keys, np.unique(twice))


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``among``."""
    if not len(among) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


class HashSet:
    """A fixed set of 64-bit hashes with a bit table in front, so that most misses cost one look-up."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys.astype(np.uint64))
        self.shift = np.uint64(64 - max(16, min(26, (16 * len(self.keys) + 1).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that are in the set."""
        maybe = np.flatnonzero(self.bits[hashes >> self.shift])
        return maybe[member(hashes[maybe], self.keys)]
