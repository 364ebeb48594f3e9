"""Benchmark decontamination: words of documents that lie in a window of words of a benchmark item.

Method: the windows of the normalised items go to all tasks as a hash set; the windows of each document are looked up in
it by rolling hashes, every hit is verified word by word, and the hit words become spans that can be cut out.

The benchmark is the small side, and the size of its index is checked: the items' words are counted first, and an index over
``max_index_bytes`` is built and broadcast in parts, one after the other.  Each part then gives only its hits, by the hash of the text they
are in; the hits of all parts are merged and joined to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as k
from .shared import Packed, checkpoint, small_batches

WINDOW = 10
_HITS = "spans array<struct<start:int,end:int>>, items array<string>"
_FOUND = f"n_words long, n_hit long, {_HITS}"
#: Bytes of an index for each word of an item, at most: two hashes, the item, the group, where the window begins and ends, and the set of hashes.
_WORD_BYTES = 64


@dataclass
class Index:
    """Windows of so many words, as flat arrays.  Window g has the hash hashes[g] (in order), the bytes data[begin[g]:end[g]] (its
    words, folded, a space between) and the items item[first[g]:first[g + 1]]; equal hashes of different words are neighbours."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    item: np.ndarray
    data: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values())


def _squeezed(s: k.Slice, w: k.Words) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of all words, a space after each, and where each word begins."""
    size = w.ends - w.starts + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.full(begin[-1], 0x20, np.uint8)
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    inside = at < np.repeat(size - 1, size)
    out[inside] = k.LOWER[s.data[(np.repeat(w.starts, size) + at)[inside]]]
    return out, begin


def index(texts: list[str | None], window: int) -> dict[int, Index]:
    """Windows of the texts, by their number of words; an item is the place of its text in the list."""
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    buffers, shift = [], 0
    for s in k.slices(pa.array(texts, pa.large_string())):
        w = k.words(s, k.ALNUM, k.LOWER)
        data, begin = _squeezed(s, w)
        edges = np.concatenate([[0], np.cumsum(w.counts)])
        sizes = np.minimum(w.counts, window)
        for size in np.unique(sizes[sizes > 0]).tolist():
            hashes, first = k.window_hashes(w, size)
            mine = (sizes[w.row[first]] == size) & ((size == window) | (first == edges[w.row[first]]))
            hashes, first = hashes[mine], first[mine]
            again = k.span_hashes(data, begin[first], begin[first + size] - 1)
            found.setdefault(size, []).append((hashes, again, begin[first] + shift, begin[first + size] - 1 + shift, (w.row[first] + s.first).astype(np.int32)))
        buffers.append(data)
        shift += len(data)
    data = np.concatenate(buffers) if buffers else np.zeros(0, np.uint8)
    out = {}
    for size, parts in found.items():
        hashes, again, begin, end, item = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((item, again, hashes))
        hashes, again, begin, end, item = (x[order] for x in (hashes, again, begin, end, item))
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (again[1:] != again[:-1])])
        entry = new | np.concatenate([[True], item[1:] != item[:-1]])  # an item once a window
        group = np.flatnonzero(new[entry])
        out[size] = Index(hashes[new], begin[new], end[new], np.concatenate([group, [entry.sum()]]), item[entry], data)
    return out


def _joined(s: k.Slice, w: k.Words, first: int, size: int) -> bytes:
    """The window's words, folded, with a space between."""
    return b" ".join(k.LOWER[s.data[w.starts[i] : w.ends[i]]].tobytes() for i in range(first, first + size))


class Finder:
    def __init__(self, table: dict[int, Index], ids: list[str | None]):
        self.sizes = {size: (k.HashSet(x.hashes), x) for size, x in table.items()}
        self.ids = ids

    def __call__(self, s: k.Slice) -> tuple[np.ndarray, list[set], k.Words, np.ndarray]:
        """For each row of the slice: number of words and item ids; all words, and which of them are hit."""
        w = k.words(s, k.ALNUM, k.LOWER)
        items: list[set] = [set() for _ in range(s.rows)]
        cover = np.zeros(len(w.hashes) + 1, np.int64)
        for size, (known, x) in self.sizes.items():
            hashes, first = k.window_hashes(w, size)
            at = known.find(hashes)
            low, high = np.searchsorted(x.hashes, hashes[at]), np.searchsorted(x.hashes, hashes[at], "right")
            for a, lo, hi in zip(first[at].tolist(), low.tolist(), high.tolist(), strict=True):
                words = _joined(s, w, a, size)
                for g in range(lo, hi):
                    if x.data[x.begin[g] : x.end[g]].tobytes() == words:
                        cover[a] += 1
                        cover[a + size] -= 1
                        items[w.row[a]].update(self.ids[i] for i in x.item[x.first[g] : x.first[g + 1]].tolist())
        return w.counts, items, w, np.cumsum(cover[:-1]) > 0


def _spans(s: k.Slice, w: k.Words, hit: np.ndarray, row: int) -> list[tuple[int, int]]:
    """Byte spans of runs of hit words of a row."""
    a, b = np.searchsorted(w.row, [row, row + 1])
    at = np.flatnonzero(hit[a:b]) + a
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [(int(x - s.offsets[row]), int(y - s.offsets[row])) for x, y in zip(w.starts[first], w.ends[last], strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _found(s: k.Slice, counts: np.ndarray, w: k.Words, hit: np.ndarray, items: list) -> dict[str, pa.Array]:
    n_hit = np.bincount(w.row[hit], minlength=s.rows)
    spans = [[{"start": x, "end": y} for x, y in _spans(s, w, hit, row)] if n_hit[row] else [] for row in range(s.rows)]
    ids = [sorted(x for x in i if x is not None) for i in items]
    return {"n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(ids, pa.list_(pa.string()))}


def _scan(shared, names: list[str], only_hits: bool = False):
    """Adds what the benchmark, or a part of it, finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*shared.value)
        for b in batches:
            get = lambda x, c: x.column(x.schema.get_field_index(c))
            for s in k.slices(get(b, "__text")):
                part = b.slice(s.first, s.rows)
                counts, items, w, hit = finder(s)
                made = _found(s, counts, w, hit, items)
                out = pa.RecordBatch.from_arrays([made[c] if c in made else get(part, c) for c in names], names)
                yield out.filter(pc.greater(made["n_hit"], 0)) if only_hits else out

    return run


def _merge(names: list[str]):
    """From the spans and items of all parts, __spans and __items, what one index would have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda x, c: x.column(x.schema.get_field_index(c))
            for s in k.slices(get(b, "__text")):
                part = b.slice(s.first, s.rows)
                w = k.words(s, k.ALNUM, k.LOWER)
                hit = np.zeros(len(w.hashes), bool)
                for row, spans in enumerate(get(part, "__spans").to_pylist()):
                    for x in spans or ():
                        a, z = np.searchsorted(w.starts, [s.offsets[row] + x["start"], s.offsets[row] + x["end"]])
                        hit[a:z] = True
                made = _found(s, w.counts, w, hit, [{*(x or ())} for x in get(part, "__items").to_pylist()])
                yield pa.RecordBatch.from_arrays([made[c] if c in made else get(part, c) for c in names], names)

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of an index of each item, at most."""
    for b in batches:
        for s in k.slices(b.column(b.schema.get_field_index("t"))):
            w = k.words(s, k.ALNUM, hashed=False)
            yield pa.RecordBatch.from_arrays([pa.array(_WORD_BYTES * w.counts + np.diff(s.offsets) + 64)], ["size"])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_index_bytes: int = 128 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, carry, n_words, n_hit, spans (byte offsets of runs of hit words) and items (ids as strings, sorted) of each row.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.  An item of fewer words than the
    window, but not none, is one window.  Null and empty texts have no words; items with the same id are one item; an
    item without id marks words but is in no list; an empty benchmark finds nothing; repeated rows are judged alike.
    Only an item that is larger than ``max_index_bytes`` by itself makes a larger part.
    """
    columns = list(dict.fromkeys([*keys, *carry]))
    rows = docs.select(*(F.col(c) for c in columns), F.col(text).cast("string").alias("__text"))
    return _find(rows, columns, benchmark, item, item_text, window, max_index_bytes).drop("__text")


def _find(rows: DataFrame, columns: list[str], benchmark: DataFrame, item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_index_bytes: int = 128 << 20) -> DataFrame:
    """rows (columns, __text) with what find_benchmark() adds."""
    small_batches(rows.sparkSession)
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = items.mapInArrow(k.task(_sizes), "size long").agg(F.sum("size")).head()[0] or 0
    parts = -(-total // max_index_bytes) or 1
    names = [*columns, "__text", "n_words", "n_hit", "spans", "items"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + f", __text string, {_FOUND}"

    def broadcast(chosen: DataFrame):
        found = chosen.collect()  # of a checked size
        return rows.sparkSession.sparkContext.broadcast((index([r.t for r in found], window), [r.i for r in found]))

    if parts == 1:
        return rows.mapInArrow(k.task(_scan(broadcast(items), names)), schema)
    # results depend on the text alone, so hits are told by two hashes of it
    hashes = [F.xxhash64("__text").alias("__h1"), F.xxhash64("__text", F.lit(1)).alias("__h2")]
    pieces = []
    for part in range(parts):
        shared = broadcast(items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part))
        hits = rows.select("__text", *hashes).mapInArrow(k.task(_scan(shared, ["__h1", "__h2", "n_hit", "spans", "items"], True)), f"__h1 long, __h2 long, n_hit long, {_HITS}")
        pieces.append(checkpoint(hits.groupBy("__h1", "__h2").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))))
    every = reduce(DataFrame.unionAll, pieces).groupBy("__h1", "__h2").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"))
    return rows.select("*", *hashes).join(every, ["__h1", "__h2"], "left").mapInArrow(k.task(_merge(names)), schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_share: float = 0.5, **options) -> DataFrame:
    """docs without the spans of benchmark windows; rows of which more than ``drop_share`` of the words are hit go."""
    packed = Packed(docs, text)
    found = _find(packed.rows, ["__row"], benchmark, **options)
    kept = found.filter(F.col("n_hit") <= drop_share * F.col("n_words"))
    data = F.encode(F.col("__text"), "UTF-8")
    # cut from the last span to the first, so offsets stay right
    cut = F.aggregate(F.reverse("spans"), data, lambda rest, x: F.concat(F.substring(rest, F.lit(1), x["start"]), F.substring(rest, x["end"] + 1, F.octet_length(rest))))
    return packed.unpack(kept, F.when(F.col("n_hit") > 0, F.decode(cut, "UTF-8")))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
