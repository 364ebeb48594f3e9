"""SentencePiece segmentations, sampled and reproducible, and lossless decoding.

A text is cut before each run of spaces (as the library does before it looks for pieces); each part is a word over a
lattice of pieces.  A piece's probability follows its rank in the model; a character that no piece holds falls back to its
bytes.  Forward filtering adds up the weights of all ways to reach each character of a word, once for each distinct word
that a worker meets; backward sampling then walks from the end to the start, choosing each piece with its posterior probability.
The choices come from a hash of the row's key, the word's place and the step, so the same row always gets the same segments,
in whatever order and batch it is read.  All words of a batch take their steps together; a word of more than LONG characters (a text
without spaces, say) is worked through alone in windows, forwards and then backwards, so time follows its length and
memory the window.

Decoding puts pieces and bytes together again; texts come back unchanged (a literal U+2581, which the library would turn
into a space, is encoded by its bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as k
from .shared import small_batches

MARK = 0x2581
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
LONG = 1024
WINDOW = 1 << 14  # characters of a long word whose lattice is held at once
NODES = 1_000_000  # characters of the words whose lattices a worker keeps, but for those of one slice


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes starts[i] ... starts[i] + counts[i] - 1, one run after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class Pieces:
    """The pieces of a model by hash of their characters, and their weights."""

    def __init__(self, path: str, temperature: float):
        from sentencepiece import sentencepiece_model_pb2 as model

        spec = model.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.bytes = np.full(256, -1, np.int64)
        self.text: list[bytes] = []
        codes, ids, weights = [], [], []
        for i, p in enumerate(spec.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.text.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type in (1, 4):
                codes.append(np.frombuffer(p.piece.encode("utf-32-le"), np.uint32))
                ids.append(i)
                weights.append((i + 10.0) ** (-1 / temperature))  # by rank, as in Zipf's law
                self.text.append(p.piece.replace(chr(MARK), " ").encode())
            else:
                self.text.append(b"")
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, codes))
        self.lines = not any(0x0A in c for c in codes)
        flat, edges = np.concatenate(codes), np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        hashes = k.span_hashes(flat, edges[:-1], edges[1:])
        order = np.argsort(hashes)
        self.hashes, self.ids, self.lengths = hashes[order], np.array(ids)[order], np.diff(edges)[order]
        self.weights = np.array(weights)[order] / sum(weights)
        self.byte_weight = self.weights.min() * 1e-3
        self.front = np.zeros(1 << 20, bool)
        self.front[self.hashes >> np.uint64(44)] = True
        # ends of pieces: a run of characters that ends no piece cannot be the end of a longer one
        lengths = np.diff(edges)
        stop = np.repeat(edges[1:], lengths)
        self.tails = np.zeros(1 << 22, bool)
        self.tails[k.span_hashes(flat, np.arange(len(flat)), stop) >> np.uint64(42)] = True

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Index of the piece of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.front[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = (self.hashes[at] == hashes[maybe]) & (self.lengths[at] == length)
        out[maybe[hit]] = at[hit]
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of a row's ids, without the space that encoding puts in front."""
        return None if ids is None else b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


_open: dict[tuple[str, float], Pieces] = {}


def pieces(model: str, temperature: float) -> Pieces:
    """The pieces of a file of the public_tokenizers package, or of a path that all workers have; read once a worker."""
    import os

    if (model, temperature) not in _open:
        path = model
        if os.path.sep not in model:
            import public_tokenizers

            path = str(public_tokenizers.path(model))
        _open[model, temperature] = Pieces(path, temperature)
    return _open[model, temperature]


def lattice_edges(p: Pieces, codes: np.ndarray, place: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, piece (-1: bytes) and end of every way to end a piece at one of the characters ``last``, by end; place: of each
    character in its word."""
    nodes, n = last, len(codes)
    ends, sizes, found = [], [], []
    hash_ = k.SpanHasher(codes)
    for size in range(1, p.longest + 1):
        last = last[place[last] >= size - 1]
        if not len(last):
            break
        h = hash_(last - size + 1, last + 1)
        at = p.find(h, size)
        hit = at >= 0
        ends.append(last[hit])
        sizes.append(np.full(hit.sum(), size))
        found.append(at[hit])
        last = last[p.tails[h >> np.uint64(42)]]
    end, size, piece = np.concatenate(ends), np.concatenate(sizes), np.concatenate(found)
    single = np.zeros(n, bool)
    single[end[size == 1]] = True
    bare = nodes[~single[nodes]]  # characters that only bytes can give
    end, size, piece = np.concatenate([end, bare]), np.concatenate([size, np.ones(len(bare), np.int64)]), np.concatenate([piece, np.full(len(bare), -1)])
    order = np.argsort(end, kind="stable")
    return size[order], piece[order], end[order]


class Lattice:
    """Pieces that end at each character of some words, with the chance of each in backward sampling."""

    def __init__(self, p: Pieces, codes: np.ndarray, edges: np.ndarray):
        """codes: characters of all words; edges: where words begin.  Node i is the end of character i."""
        n, words = len(codes), len(edges) - 1
        word = np.repeat(np.arange(words), np.diff(edges))
        place = np.arange(n) - edges[word]  # of a character in its word
        self.size, self.piece, end = lattice_edges(p, codes, place, np.arange(n))
        self.start = np.searchsorted(end, np.arange(n + 1))
        # forward: all words at once, character by character; each word has a slot for its beginning and one for each character
        slot = np.arange(n) + word + 1
        forward = np.ones(n + words)
        by_place = np.argsort(place[end], kind="stable")
        weight = np.where(self.piece >= 0, p.weights[self.piece], p.byte_weight)[by_place]
        ends = end[by_place]
        before = slot[ends] - self.size[by_place]
        cuts = np.searchsorted(place[ends], np.arange(place.max() + 2 if n else 1))
        ways = np.empty(len(ends))
        for d in range(len(cuts) - 1):
            some = slice(cuts[d], cuts[d + 1])
            ways[some] = weight[some] * forward[before[some]]
            nodes = ends[some]
            firsts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
            at = slot[nodes[firsts]]
            forward[at] = np.add.reduceat(ways[some], firsts)
            if d % 8 == 7:  # long words: what later pieces can reach is scaled up, as only ratios matter
                factor = 1 / forward[at]
                for back in range(min(d + 2, p.longest + 8)):
                    forward[at - back] *= factor
        # cumulated within each node alone: a word's chances must not depend on the words beside it
        chance = np.empty(len(ends))
        chance[by_place] = ways
        counts, total = np.diff(self.start), np.zeros(n)
        for r in range(int(counts.max()) if n else 0):
            some = np.flatnonzero(counts > r)
            edge = self.start[some] + r
            total[some] += chance[edge]
            chance[edge] = total[some]
        chance /= total[end]
        chance[self.start[1:] - 1] = 2.0  # the last choice takes whatever is left
        self.chance = chance.astype(np.float32)  # cumulated over the pieces that end at a node
        self.size, self.piece = self.size.astype(np.int32), self.piece.astype(np.int32)


class Growing:
    """An array that is appended to; its room doubles, so appending does not copy all that is there."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.room):
            room = np.zeros(max(need, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : need] = more
        self.n = need


class Words:
    """Lattices of the words that a worker has met, as one; started again when it holds NODES characters."""

    def __init__(self, p: Pieces):
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.first = self.last = np.zeros(0, np.int64)
        self.held = {"start": Growing(np.int64), "size": Growing(np.int32), "piece": Growing(np.int32), "chance": Growing(np.float32), "codes": Growing(np.uint32)}
        self.held["start"].extend(np.zeros(1, np.int64))

    def __getattr__(self, name: str) -> np.ndarray:
        """start, size, piece, chance and codes, with room behind them."""
        if name not in self.__dict__.get("held", ()):
            raise AttributeError(name)
        return self.held[name].room

    def learn(self, hashes: np.ndarray, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where the words (sorted distinct hashes; first character and number of characters in codes) are held."""
        if self.held["codes"].n + int(size.sum()) > NODES:
            self.clear()
        new = np.flatnonzero(~k.member(hashes, self.hashes))
        if len(new):
            edges = np.concatenate([[0], np.cumsum(size[new])])
            some = codes[_ragged(first[new], size[new])]
            lattice = Lattice(self.p, some, edges)
            nodes, edge = self.held["codes"].n, int(self.start[self.held["start"].n - 1])
            at = np.searchsorted(self.hashes, hashes[new])
            self.hashes = np.insert(self.hashes, at, hashes[new])
            self.first = np.insert(self.first, at, edges[:-1] + nodes)
            self.last = np.insert(self.last, at, edges[1:] + nodes - 1)
            for name, more in (("start", lattice.start[1:] + edge), ("size", lattice.size), ("piece", lattice.piece), ("chance", lattice.chance), ("codes", some)):
                self.held[name].extend(more)
        return np.searchsorted(self.hashes, hashes)

    def sample(self, last: np.ndarray, first: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words that occur (last and first character, seed): edge, occurrence, step and end of each piece taken."""
        out, who, at, step = [], np.arange(len(last)), last.copy(), 0
        start, chance, size = self.start, self.chance, self.size
        while len(who):
            u = (k.mix(seeds[who] + np.uint64(step * int(_BASE) & _ALL)) >> np.uint64(11)).astype(float) * 2.0**-53
            low, high = start[at], start[at + 1]
            edge = low.copy()
            moving = np.arange(len(who))
            while len(moving):  # first edge whose cumulated chance is above u
                moving = moving[(chance[edge[moving]] <= u[moving]) & (edge[moving] < high[moving] - 1)]
                edge[moving] += 1
            out.append((edge, who, np.full(len(who), step, np.int32), at))
            at = at - size[edge]
            more = at >= first[who]
            who, at, step = who[more], at[more], step + 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _filter(before: list[float], start: list[int], size: list[int], weight: list[float], longest: int) -> tuple[list[float], list[float]]:
    """Forward weights behind those of the nodes before, and, for each edge, the cumulated chances of the edges of its node."""
    f, off, chance = list(before), len(before), [0.0] * len(size)
    for i in range(len(start) - 1):
        total = 0.0
        for e in range(start[i], start[i + 1]):
            total += weight[e] * f[off + i - size[e]]
            chance[e] = total
        for e in range(start[i], start[i + 1]):
            chance[e] /= total
        f.append(total)
        if not 1e-100 < total < 1e100:  # only ratios matter
            f[-longest:] = [x / total for x in f[-longest:]]
    return f[-longest:], chance


def long_word(p: Pieces, codes: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A sampled segmentation of one word: pieces (-1: bytes) and the character that each ends at.

    The forward pass keeps the weights at the beginning of each window alone; the backward pass makes each window's lattice again.
    """
    n = len(codes)

    def window(a: int, b: int) -> tuple[list, list, list, np.ndarray]:
        base = max(0, a - p.longest + 1)
        part = codes[base:b]
        size, piece, end = lattice_edges(p, part, np.arange(len(part)) + base, np.arange(a - base, b - base))
        start = np.searchsorted(end, np.arange(a - base, b - base + 1))
        return start.tolist(), size.tolist(), np.where(piece >= 0, p.weights[piece], p.byte_weight).tolist(), piece

    begins, f = [], [1.0]
    for a in range(0, n, WINDOW):
        begins.append(f)
        f, _ = _filter(f, *window(a, min(n, a + WINDOW))[:3], p.longest)
    pieces_, ends, at, step = [], [], n - 1, 0
    for a, before in zip(range(0, n, WINDOW)[::-1], begins[::-1], strict=True):
        b = min(n, a + WINDOW)
        start, size, weight, piece = window(a, b)
        _, chance = _filter(before, start, size, weight, p.longest)
        steps = (np.arange(b - a, dtype=np.uint64) + np.uint64(step)) * _BASE
        draws = ((k.mix(seed + steps) >> np.uint64(11)).astype(float) * 2.0**-53).tolist()
        taken, stops = [], []
        while at >= a:
            edge, last = start[at - a], start[at - a + 1] - 1
            while edge < last and chance[edge] <= draws[len(taken)]:
                edge += 1
            taken.append(edge)
            stops.append(at)
            at -= size[edge]
        step += len(taken)
        pieces_.append(piece[np.array(taken[::-1], np.int64)])
        ends.append(np.array(stops[::-1], np.int64))
    return np.concatenate(pieces_[::-1]), np.concatenate(ends[::-1])


def encode(known: Words, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the number of ids of each."""
    # an empty text has no pieces; any other gets a space in front, as in the library
    whole = [" " + t if t else "" for t in texts]
    codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in whole])]).astype(np.int64)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    space = codes == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    if known.p.lines:  # no piece holds a newline
        newline = np.flatnonzero(codes == 0x0A)
        begins[newline] = True
        begins[newline[newline < len(codes) - 1] + 1] = True
    begins[edges[:-1][np.diff(edges) > 0]] = True
    start = np.flatnonzero(begins)
    stop = np.append(start[1:], len(codes))
    row = np.searchsorted(edges, start, "right") - 1
    literal = codes == MARK
    marked = np.where(space, np.uint32(MARK), np.where(literal, np.uint32(0xFFFFFFFF), codes))
    number = np.arange(len(start)) - np.searchsorted(row, row)  # of a word in its row
    word_seeds = k.mix(seeds[row] + k.mix(number.astype(np.uint64) + np.uint64(1)))
    p = known.p
    long = stop - start > LONG
    short = np.flatnonzero(~long)
    x, y = start[short], stop[short]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(k.span_hashes(marked[x[a] : y[b - 1]], x[a:b] - x[a], y[a:b] - x[a]) for a, b in _chunks(x, y))])
    # a lattice is made once for each distinct word
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    held = known.learn(distinct, marked, x[first], (y - x)[first])[inverse]
    edge, who, step, at = known.sample(known.last[held], known.first[held], word_seeds[short])
    order = np.lexsort((-step, who))  # steps run backwards
    edge, who, at = edge[order], short[who[order]], at[order]
    piece, code = known.piece[edge].astype(np.int64), known.codes[at]
    if long.any():
        parts = [(piece, who, code)]
        for w in np.flatnonzero(long).tolist():
            own = marked[start[w] : stop[w]]
            some, ends = long_word(p, own, word_seeds[w])
            parts.append((some, np.full(len(some), w), own[ends]))
        piece, who, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(who, kind="stable")
        piece, who, code = piece[order], who[order], code[order]
    ids = np.where(piece >= 0, p.ids[piece], -1)
    bare = np.flatnonzero(piece < 0)
    rows = row[who]
    if len(bare):
        spelled = [p.bytes[np.frombuffer(chr(MARK if c == 0xFFFFFFFF else c).encode("utf-8", "surrogatepass"), np.uint8)] for c in code[bare].tolist()]
        counts = np.ones(len(ids), np.int64)
        counts[bare] = [len(x) for x in spelled]
        ids, rows = np.repeat(ids, counts), np.repeat(rows, counts)
        ids[ids < 0] = np.concatenate(spelled)
    return ids, np.bincount(rows, minlength=len(texts))


def _chunks(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of words of some 2**20 characters; the power tables of the hashes stay small."""
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(stop, start[a] + k.SLICE, "right")))
        yield a, b
        a = b


def encode_pieces(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), seed: Column | None = None, model: str = "piece_bpe_32k.model", temperature: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, carry, ids (array of int) and lossless (decoding gives the text back) of each row.

    The sample of a row depends on its keys (or ``seed``, a long), its text, the model and the temperature alone; repeated rows are
    sampled alike.  A null text has null ids; an empty one none.  Columns that are called ids or lossless are replaced.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in dict.fromkeys([*keys, *carry]) if c not in ("ids", "lossless")]
    kinds_of = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kinds = ", ".join(f"`{c}` {kinds_of[c]}" for c in columns)
    own = F.xxhash64(*keys) if seed is None else seed.cast("long")
    # a text that is carried goes to the worker once
    at = columns.index(text) if text in columns and kinds_of[text] == "string" else len(columns) + 1
    extra = [] if at < len(columns) else [F.col(text).cast("string").alias("__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, temperature)
        known = Words(p)
        for b in batches:
            for s in k.slices(b.column(at)):
                part = b.slice(s.first, s.rows)
                own = part.column(at).to_pylist()
                seeds = k.mix(part.column(len(columns)).to_numpy().astype(np.int64).view(np.uint64))
                ids, counts = encode(known, [t or "" for t in own], seeds)
                ends = np.concatenate([[0], np.cumsum(counts)])
                null = pa.array([t is None for t in own], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=null)
                flat = ids.tolist()
                same = [t is None or p.decode(flat[x:y]) == t for t, x, y in zip(own, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), lists, pa.array(same)], [*columns, "ids", "lossless"])

    return docs.select(*(F.col(c) for c in columns), own.alias("__seed"), *extra).mapInArrow(k.task(run), f"{kinds}, ids array<int>, lossless boolean")


def decode_pieces(encoded: DataFrame, ids: str = "ids", text: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """encoded with a text column made from its ids; null ids give null."""
    names = [c for c in encoded.columns if c != text]
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, 1.0)
        for b in batches:
            out = pa.array([p.decode(x) for x in b.column(names.index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*names, text])

    return encoded.select(*names).mapInArrow(k.task(run), f"{kinds}, `{text}` string")
