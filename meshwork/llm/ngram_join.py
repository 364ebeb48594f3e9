"""N-gram Jaccard join: documents whose sets of word n-grams are nearly equal, and the components they form.

Two texts link if 100 * |intersection| >= threshold * |union|.  Method: rare-first prefix filtering with length, positional
and suffix filters; each pair is verified once, on whole sets, and a pair that is already connected needs no check.

1. One scan hashes the n-grams.  Candidates are sought among a share of the hash space that depends on the size of a set
   (everything for small sets); bands of size overlap by the threshold, so a pair meets in one band at least.  A set of n
   can lack m = n - ceil(t * n) of its n-grams in a partner.  Its n-grams in the band are put in order of how many texts have them,
   rarest first: of any m + 1 of them a partner has one.  So the first m + 1 are its prefix, and a text with more than m
   n-grams that no other text has links with nothing - most texts end here.  A text with no more than m n-grams in its band
   would not be safe; if there is one, the bands are moved up and the scan is made again.
   The first scan also finds, by bounded counters in each task, n-grams that very many texts have (a passage
   in a third of them, say): these come last in the order without being counted, so no task gathers all texts that have one.
2. Texts that share a prefix n-gram, and whose lengths allow a link, fall into clusters (connected components by joins).
3. The texts of a cluster are dealt to blocks; each block is joined in one task, exactly: rare-first prefixes, length,
   positional and suffix (size by range of n-grams) filters, then verification.  Tasks return a spanning forest of the links,
   never all pairs.  In a cluster of several blocks, one text of each component goes on to the next round, as long as rounds
   bring the components down; then texts of different components that share a prefix n-gram meet in all pairs of blocks.
   So a large group of near copies costs a few rounds, and its blocks are crossed only for what has not been joined.
4. Components of the forest, by joins.

Equal texts are one node throughout, by a 64-bit hash; hashes that two different texts share are found by a second hash, and
such texts get another key.  N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.plans.contraction import components

from . import textkernel as k
from .shared import Scratch, checkpoint, partitions, small_batches

#: By threshold: band edges (set sizes) and, for each band, the share of the hash space in 1/8.  A share has to be well above
#: what a set can lack; below the last threshold everything is used.
BANDS = ((90, ((0, 8), (64, 4), (384, 2))), (80, ((0, 8), (64, 5), (128, 4), (512, 3))), (0, ((0, 8),)))
BLOCK_ROWS = 256
BLOCK_GRAMS = 1 << 21
_SUFFIX_PARTS = 16
HOT = 16_384  # n-grams that a task reports, and that are held to be hot, at most
COUNTED = 500_000  # n-grams that a task's counter takes in before it is thinned out
SEEN = 1_000_000  # keys by which a task tells copies
FEW = 500_000  # keys (8 bytes each) or rows that are broadcast, at most; their number is counted


def bands_for(threshold: int) -> tuple:
    return next(bands for least, bands in BANDS if threshold >= least)


def missing(n: np.ndarray, threshold: int) -> np.ndarray:
    """How many elements of a set of n a linked set can lack."""
    return n - -(-threshold * n // 100)


def sets(s: k.Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row of a slice, one row after the other, and where each row's begin."""
    w = k.words(s, k.NOT_SPACE, k.LOWER)
    h, first = k.window_hashes(w, size)
    row = w.row[first]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        edges = np.concatenate([[0], np.cumsum(w.counts)])
        extra = k.span_hashes(w.hashes, edges[short], edges[short + 1])
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(s.rows + 1))


def _get(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def band_grams(own: np.ndarray, threshold: int, bands: tuple) -> list[tuple[int, np.ndarray]]:
    """(band, n-grams of it) for the bands that a set takes part in; the band is mixed into its n-grams."""
    n, out = len(own), []
    for band, (low, share) in enumerate(bands):
        high = bands[band + 1][0] if band + 1 < len(bands) else None
        # a pair meets in the band of its smaller set, which holds all sets up to 1/t times its upper edge
        if n >= low and (high is None or threshold * n <= 100 * high):
            some = own if share == 8 else own[(own >> np.uint64(61)) < np.uint64(share)]
            out.append((band, k.mix(some + np.uint64(band))))
    return out


class Frequent:
    """A bounded counter of n-grams over the texts of a task."""

    def __init__(self) -> None:
        self.grams, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.waiting = self.texts = 0

    def add(self, grams: np.ndarray) -> None:
        self.new.append(grams)
        self.waiting += len(grams)
        if self.waiting > COUNTED:
            self.merge()

    def merge(self) -> None:
        grams = np.concatenate([self.grams, *self.new])
        counts = np.concatenate([self.counts, np.ones(self.waiting, np.int64)])
        self.grams, at = np.unique(grams, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.grams)).astype(np.int64)
        self.new, self.waiting = [], 0
        if len(self.grams) > COUNTED // 4:
            top = np.argsort(-self.counts, kind="stable")[: COUNTED // 4]
            top.sort()
            self.grams, self.counts = self.grams[top], self.counts[top]

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        """Those that at least 64 texts and one in 500 have, the most frequent first."""
        self.merge()
        top = np.argsort(-self.counts, kind="stable")[:HOT]
        top = top[self.counts[top] >= max(64, self.texts // 500)]
        return self.grams[top].view(np.int64), self.counts[top]


def _sizes(size: int, threshold: int, bands: tuple):
    """(row, key, n) of each row, and at the end of a task one row with its most frequent n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = Frequent(), set()
        lists = lambda x: pa.array(x, pa.list_(pa.int64()))
        names = ["row", "key", "n", "hot", "hot_n"]
        kind = None
        for b in batches:
            kind = _get(b, "row").type
            keys = _get(b, "key").to_numpy()
            for s in k.slices(_get(b, "text")):
                part = b.slice(s.first, s.rows)
                h, edges = sets(s, size)
                for i in range(s.rows):
                    key = int(keys[s.first + i])
                    if key not in seen and len(seen) < SEEN:  # copies count once
                        seen.add(key)
                        frequent.texts += 1
                        for _, grams in band_grams(h[edges[i] : edges[i + 1]], threshold, bands):
                            frequent.add(grams)
                yield pa.RecordBatch.from_arrays([_get(part, "row"), _get(part, "key"), pa.array(np.diff(edges), pa.int64()), lists([None] * s.rows), lists([None] * s.rows)], names)
        if kind is not None:
            grams, counts = frequent.top()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([None], pa.int64()), pa.array([None], pa.int64()), lists([grams.tolist()]), lists([counts.tolist()])], names)

    return run


def _grams(size: int, threshold: int, bands: tuple, shared):
    """(key, n, band, total, grams, hot): n-grams of each new key that are not hot, and their number (null if the band isn't safe).

    hot: the first hot ones, as many as a prefix takes in if all others come before them; none, for most texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hot = shared.value
        for b in batches:
            keys = _get(b, "key").to_numpy()
            for s in k.slices(_get(b, "text")):
                h, edges = sets(s, size)
                out: list[tuple] = []
                for i in range(s.rows):
                    key, n = int(keys[s.first + i]), int(edges[i + 1] - edges[i])
                    if not n or key in seen:  # a copy in the same task
                        continue
                    if len(seen) < SEEN:
                        seen.add(key)
                    for band, grams in band_grams(h[edges[i] : edges[i + 1]], threshold, bands):
                        known = k.member(grams, hot)
                        cold, lack = grams[~known], n - -(-threshold * n // 100)
                        out.append((key, n, band, len(cold) if len(grams) > lack else None, cold.view(np.int64), np.sort(grams[known])[: max(0, lack + 1 - len(cold))].view(np.int64)))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], ["key", "n", "band", "total", "grams", "hot"])

    return run


def prefixes(texts: DataFrame, size: int, threshold: int, bands: tuple, hot: np.ndarray) -> DataFrame | None:
    """(key, n, grams, hot): prefix n-grams that more than one text has, hot ones apart, of texts that may link; None if a text isn't safe.

    N-grams known to be hot come last in the order, and their rows are not gathered to be counted; as HOT of them are known, any other
    has less than one in HOT of all rows, which is the most that one key brings to a task.  Every n-gram is dealt once, to be
    counted; only those that several texts have go on, as a text's other n-grams
    are what they lack of its total.
    """
    shared = texts.sparkSession.sparkContext.broadcast(hot)  # HOT at most
    found = texts.mapInArrow(k.task(_grams(size, threshold, bands, shared)), "key long, n int, band int, total int, grams array<long>, hot array<long>")
    # a text's numbers in one column: n, total and band; -1 shows a text that isn't safe
    packed = F.coalesce(F.shiftleft(F.col("n").cast("long"), 34) + F.shiftleft(F.col("total").cast("long"), 3) + F.col("band"), F.lit(-1).cast("long")).alias("packed")
    rows = found.select("key", packed, F.explode(F.when(F.col("total").isNotNull(), F.col("grams")).otherwise(F.array("key"))).alias("gram"))
    gram = Window.partitionBy("gram")
    once = rows.withColumn("copy", F.lag("key").over(gram.orderBy("key", "packed")) == F.col("key")).filter("copy is null or not copy or packed < 0")
    counted = once.select("key", "packed", "gram", F.count("*").over(gram).cast("int").alias("df")).filter("df > 1 or packed < 0")
    counted = counted.withColumn("hot", F.lit(None).cast("array<long>"))
    if len(hot):  # as they are, in one row a text
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("gram", "long"), ("df", "int"))]
        counted = counted.unionAll(found.filter("total is not null and size(hot) > 0").select("key", packed, *none, "hot"))
    # dealt as plain rows: sets that were begun before the shuffle would hold an n-gram or two each, and be twice as large
    by_text = counted.repartition("key").groupBy("key", "packed").agg(F.collect_set(F.when(F.col("gram").isNotNull(), F.struct("df", "gram"))).alias("shared"), F.coalesce(F.first("hot", ignorenulls=True), F.array().cast("array<long>")).alias("hot"))
    n, total = F.shiftright("packed", 34).cast("int"), F.shiftright("packed", 3).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    lacks = by_text.withColumn("n", n).withColumn("alone", total - F.size("shared")).withColumn("m", F.col("n") - F.ceil(F.col("n") * threshold / 100).cast("int"))
    kept = checkpoint(lacks.filter((F.col("packed") < 0) | (F.col("alone") <= F.col("m"))))
    if kept.filter("packed < 0").head(1):
        return None
    grams = F.transform(F.array_sort("shared"), lambda x: x["gram"])
    return kept.select("key", "n", F.slice(grams, F.lit(1), F.col("m") + 1 - F.col("alone")).alias("grams"), "hot")


def placed(postings: DataFrame, threshold: int, *more: str) -> DataFrame:
    """(gram, hot, class, key, n): sizes fall into classes as wide as the threshold allows (and a little more), so two linked texts
    are of one class or of neighbouring ones."""
    size = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / threshold) + 1e-6)).cast("int")
    marked = lambda name, hot: F.transform(name, lambda g: F.struct(g.alias("gram"), F.lit(hot).alias("hot")))
    each = postings.select(F.explode(F.concat(marked("grams", False), marked("hot", True))).alias("x"), size.alias("class"), "key", "n", *more)
    return each.select("x.gram", "x.hot", "class", "key", "n", *more)


def clusters(places: DataFrame) -> DataFrame:
    """(key, n, cluster) of texts that share a prefix n-gram with another text of a size that allows a link.

    The first text of each n-gram and pair of neighbouring classes is a centre: stars connect as well as all pairs do.  A text goes with
    the least of its centres; only the centres and what texts link among them make a graph, so copies of a text add nothing to it.
    An n-gram that is not hot has few enough texts to be gone through in one task; centres of hot ones are aggregated and joined.
    """
    gram = Window.partitionBy("gram").orderBy("class")
    ends = lambda low, high: F.struct(F.min("key").over(gram.rangeBetween(low, high)).alias("first"), F.max("key").over(gram.rangeBetween(low, high)).alias("last"))
    cold = places.filter(~F.col("hot")).select("key", "n", F.array(ends(-1, 0), ends(0, 1)).alias("x"))
    cold = cold.select("key", "n", F.explode(F.transform(F.filter("x", lambda x: x["first"] < x["last"]), lambda x: x["first"])).alias("first"))
    both = places.filter("hot").select("gram", F.explode(F.array("class", F.col("class") + 1)).alias("class"), "key", "n")
    firsts = both.groupBy("gram", "class").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").drop("last")
    # the aggregate above is one row an n-gram and class, so AQE can split the rows of a hot one in the join
    met = cold.unionAll(both.join(firsts, ["gram", "class"]).select("key", "n", "first")).groupBy("key", "n").agg(F.collect_set("first").alias("firsts"))
    met = checkpoint(met.select("key", "n", F.array_min("firsts").alias("least"), F.array_remove("firsts", F.array_min("firsts")).alias("firsts")))
    found = components(met.select("least", F.explode("firsts").alias("a")).select("a", F.col("least").alias("b")).distinct())
    return met.join(found.withColumnRenamed("key", "least"), "least", "left").select("key", "n", F.coalesce("label", "least").alias("cluster"))


class Forest:
    """Roots of the rows of a task; small enough that a union relabels by a scan."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: int, others: np.ndarray) -> list[int]:
        """Joins rows to a; returns those that were apart."""
        new = []
        for b in others.tolist():
            x, y = self.root[a], self.root[b]
            if x != y:
                self.root[self.root == max(x, y)] = min(x, y)
                new.append(b)
        return new


def join_sets(h: np.ndarray, edges: np.ndarray, threshold: int, sides: list[np.ndarray] | tuple = ()) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; sides: only links between rows that differ in all of them count.

    h holds the sets one after the other; edges where they begin.
    """
    rows = len(edges) - 1
    if rows < 2:
        return []
    _, ids, df = np.unique(h, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))  # rare first
    n = np.diff(edges)
    row = np.repeat(np.arange(rows), n)
    ids = rank[ids]
    order = np.lexsort((ids, row))
    ids = ids[order]
    m = missing(n, threshold)
    position = np.arange(len(ids)) - edges[row]
    top = np.flatnonzero((position <= m[row]) & (df[np.argsort(df, kind="stable")][ids] > 1))
    by_id = top[np.lexsort((n[row[top]], ids[top]))]
    start = np.searchsorted(ids[by_id], np.arange(len(df) + 1))
    part = np.bincount(row * _SUFFIX_PARTS + ids * _SUFFIX_PARTS // len(df), minlength=rows * _SUFFIX_PARTS).reshape(rows, _SUFFIX_PARTS)
    forest, links = Forest(rows), []
    mark = np.zeros(len(df), bool)
    for a in range(rows):
        own = ids[edges[a] : edges[a + 1]]
        lists = [by_id[start[i] : start[i + 1]] for i in own[: m[a] + 1].tolist()]
        at = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        if not len(at):
            continue
        mine = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        b, theirs = row[at], position[at]
        # length: the smaller set leads, so each pair is met once
        ok = ((n[b] > n[a]) | ((n[b] == n[a]) & (b > a))) & (threshold * n[b] <= 100 * n[a]) & (forest.root[b] != forest.root[a])
        for side in sides:
            ok &= side[b] != side[a]
        b, theirs, mine = b[ok], theirs[ok], mine[ok]
        if not len(b):
            continue
        b, first = np.unique(b, return_index=True)  # the first n-gram that both prefixes have
        need = -(-threshold * (n[a] + n[b]) // (100 + threshold))
        reach = 1 + np.minimum(n[a] - mine[first] - 1, n[b] - theirs[first] - 1)
        b, need = b[reach >= need], need[reach >= need]
        apart = np.abs(part[b] - part[a]).sum(axis=1)  # at least so many are in one set only
        keep = apart <= n[a] + n[b] - 2 * need
        b, need = b[keep], need[keep]
        if not len(b):
            continue
        mark[own] = True
        total = np.array([np.count_nonzero(mark[ids[edges[x] : edges[x + 1]]]) for x in b.tolist()])
        mark[own] = False
        links += [(a, x) for x in forest.union(a, b[100 * total >= threshold * (n[a] + n[b] - total)])]
    return links


def _verify(size: int, threshold: int):
    """Forest edges (a, b) among the keys of each block (or pair of blocks) of a group of tasks."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if table.num_rows:
            table = table.combine_chunks()
            task = table.column("task").to_numpy()
            order = np.argsort(task, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
                part = table.take(pa.array(rows))
                keys, blocks, labels = (part.column(c).to_numpy() for c in ("key", "block", "label"))
                pieces = [sets(s, size) for s in k.slices(part.column("text"))]
                h = np.concatenate([x for x, _ in pieces])
                edges = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in pieces]))])
                sides = [labels] + ([blocks] if part.column("cross")[0].as_py() else [])
                out += [(int(keys[a]), int(keys[b])) for a, b in join_sets(h, edges, threshold, sides)]
        k.give_back()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _few(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows, which are counted, are at most FEW."""
    return F.broadcast(df) if df.count() <= FEW else df


@dataclass(frozen=True)
class Verifier:
    """Joins texts (key, text), each of them in its cluster, whole."""

    texts: DataFrame
    size: int
    threshold: int
    block_rows: int
    block_grams: int
    scratch: Scratch

    def blocks(self, members: DataFrame, seed: int) -> DataFrame:
        """members (key, n, cluster, label) with the number of blocks of their cluster, and the block of each."""
        sizes = members.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
        sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("rows") / self.block_rows), F.ceil(F.col("grams") / self.block_grams)).cast("int").alias("blocks"))
        dealt = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")).cast("int"))
        return self.scratch.write(dealt.select("key", "n", "cluster", "label", "blocks", "block"))

    def join(self, members: DataFrame, cross: bool) -> DataFrame:
        """Forest edges (a, b) between texts of different labels: within blocks, or, if cross, between all blocks of a cluster."""
        total = members.agg(F.sum(F.col("n") * (F.col("blocks") if cross else F.lit(1)))).head()[0] or 0
        bins = max(partitions(self.texts.sparkSession), -(-total // self.block_grams))
        # only members' texts go on, each once; dealt by another hash than the join was, so AQE may split a text with many copies there
        some = self.texts.join(_few(self.texts.sparkSession, members.select("key")), "key", "left_semi")
        whole = some.groupBy(F.xxhash64("key").alias("at"), "key").agg(F.first("text").alias("text")).join(members, "key")
        if cross:
            other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            whole = whole.withColumn("other", other)
        else:
            whole = whole.withColumn("other", F.col("block"))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        task = F.xxhash64("cluster", low, high)
        met = whole.select("key", "text", "block", "label", (low != high).alias("cross"), task.alias("task"), F.pmod(task, F.lit(bins)).alias("bin"))
        return self.scratch.write(met.groupBy("bin").applyInArrow(_verify(self.size, self.threshold), "a long, b long"))


def links(texts: DataFrame, size: int, threshold: int, bands: tuple, block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS, hot: np.ndarray | None = None) -> DataFrame:
    """Forest edges (a, b) between keys of texts (key, text) that link; hot: sorted n-grams known to be frequent."""
    hot = np.zeros(0, np.uint64) if hot is None else hot
    while (found := prefixes(texts, size, threshold, bands, hot)) is None:
        bands = tuple((2 * low, share) for low, share in bands)
    scratch = Scratch(texts.sparkSession)
    postings = scratch.write(found)
    verifier = Verifier(texts, size, threshold, block_rows, block_grams, scratch)
    forest = checkpoint(_forest(verifier, postings))
    scratch.clear()
    return forest


def _forest(verifier: Verifier, postings: DataFrame) -> DataFrame:
    write, threshold = verifier.scratch.write, verifier.threshold
    members = verifier.blocks(clusters(placed(postings, threshold)).withColumn("label", F.col("key")), 0)
    forest = verifier.join(members, cross=False)
    large = members.filter("blocks > 1").drop("blocks", "block")
    before = large.count()
    # texts of one component stand for each other: first one of each meets, as long as that at least halves their number
    while before:
        found = components(forest.join(large.select(F.col("key").alias("a")), "a", "left_semi"))
        large = write(large.drop("label").join(found, "key", "left").withColumn("label", F.coalesce("label", "key")))
        heads = large.filter("key = label")
        heads = write(heads.join(heads.groupBy("cluster").agg(F.count("*").alias("heads")).filter("heads > 1").drop("heads"), "cluster"))
        now = heads.count()
        if not now:
            return forest
        if 2 * now > before:
            break
        before, forest = now, write(forest.unionAll(verifier.join(verifier.blocks(heads, now), cross=False)))
    else:
        return forest
    # what is left to compare: texts of different components that share a prefix n-gram
    places = placed(postings.join(large.select("key", "label"), "key"), threshold, "label")
    mixed = places.groupBy("gram").agg(F.min("label").alias("one"), F.max("label").alias("two")).filter("one < two").select("gram")
    rest = clusters(places.join(mixed, "gram").drop("label")).join(large.select("key", "label"), "key")
    return forest.unionAll(verifier.join(verifier.blocks(rest, 1), cross=True))


def text_hash(t: Column, seed: int) -> Column:
    return F.xxhash64(t, F.lit(seed)) if seed else F.xxhash64(t)


def text_key(t: Column, shared: list[int]) -> Column:
    """A text's key: a 64-bit hash, or, for the hashes that several texts of the table share, another one."""
    key = text_hash(t, 0)
    return F.when(key.isin(shared), text_hash(t, 1)).otherwise(key) if shared else key


def _scan(docs: DataFrame, text: str, keys: tuple[str, ...], size: int, threshold: int, bands: tuple) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(row, key, n) of each row, hot n-grams, and hashes that different texts share (n * n / 2**65 of n texts are to be expected)."""
    small_batches(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = F.struct(*(F.col(c) for c in keys))
    data = docs.select(F.struct(row.alias("row"), text_hash(t, 1).alias("other")).alias("row"), text_hash(t, 0).alias("key"), t.alias("text"))
    kind = data.schema["row"].dataType.simpleString()
    scanned = checkpoint(data.mapInArrow(k.task(_sizes(size, threshold, bands)), f"row {kind}, key long, n long, hot array<long>, hot_n array<long>"))
    meta = scanned.filter("hot is null").select("row.row", "row.other", "key", "n")
    twice = meta.groupBy("key").agg(F.min("other").alias("one"), F.max("other").alias("two")).filter("one <> two").select("key")
    shared = [r.key for r in twice.collect()]
    if shared:
        meta = meta.withColumn("key", F.when(F.col("key").isin(shared), F.col("other")).otherwise(F.col("key")))
    reports = scanned.filter("hot is not null").select(F.explode(F.arrays_zip("hot", "hot_n")).alias("x"))
    top = reports.groupBy(F.col("x.hot").alias("gram")).agg(F.sum("x.hot_n").alias("n")).orderBy(F.desc("n"), "gram").limit(HOT).collect()
    return meta.drop("other"), np.sort(np.array([r.gram for r in top], np.int64).view(np.uint64)), shared


def _near_duplicates(docs: DataFrame, text: str, keys: tuple[str, ...], size: int, threshold: int, bands: tuple | None, options: dict) -> tuple[DataFrame, list[int]]:
    bands = bands or bands_for(threshold)
    meta, hot, shared = _scan(docs, text, keys, size, threshold, bands)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(text_key(t, shared).alias("key"), t.alias("text")).filter("text <> ''")
    found = components(links(texts, size, threshold, bands, hot=hot, **options))
    smallest = meta.filter("n > 0").groupBy("key").agg(F.min(F.col("row")[keys[0]]).alias("node_id"))
    labelled = checkpoint(smallest.join(found, "key", "left"))
    tops = labelled.filter("label is not null").groupBy("label").agg(F.min("node_id").alias("component_id"))
    named = labelled.join(tops, "label", "left").select("key", "node_id", F.coalesce("label", "key").alias("group_key"), F.coalesce("component_id", "node_id").alias("component_id"))
    own = F.col("row")[keys[0]]
    out = meta.join(named, "key", "left")
    return out.select(*(F.col("row")[c].alias(c) for c in keys), F.col("n").alias("n_shingles"), "key", F.coalesce("group_key", "key").alias("group_key"), F.when(F.col("n") > 0, F.col("node_id")).otherwise(own).alias("node_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id")), shared


def near_duplicates(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), size: int = 3, threshold: int = 90, bands: tuple | None = None, **options) -> DataFrame:
    """keys, n_shingles, key (the text's hash), group_key (the component's), node_id (smallest id among equal texts) and component_id for each row.

    The first of ``keys`` is the id.  A text of fewer words than ``size`` is one n-gram; null and empty texts have an empty set,
    and their row is its own component.  Null ids count only where a component has no other; repeated rows are fine.
    """
    return _near_duplicates(docs, text, keys, size, threshold, bands, options)[0]


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, threshold: int = 80, bands: tuple | None = None, **options) -> DataFrame:
    """docs with one row of each component: that with the smallest id (nulls last; of equal ids any one).  Rows without n-grams all stay.

    What goes is a table of (id, text key), which is broadcast if it is small; rows that stay are not shuffled then.
    """
    found, shared = _near_duplicates(docs, text, (key,), size, threshold, bands, options)
    found = checkpoint(found.filter("n_shingles > 0").select(F.col(key).alias("id"), "key", "group_key"))
    best = found.groupBy("group_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"), F.count("*").alias("rows"))
    several = found.join(best.filter("rows > 1"), "group_key")
    wins = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    judged = several.groupBy("id", "key").agg(F.bool_or(wins).alias("wins"), F.count("*").alias("rows"))
    # rows that are one of a kind and win need not be told apart from those without links
    acts = checkpoint(judged.filter("not wins or rows > 1").select(F.col("id").alias("act_id"), F.col("key").alias("act_key"), "wins"))
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col(key).alias("id"), text_key(F.coalesce(F.col(text).cast("string"), F.lit("")), shared).alias("key"))
    met = rows.join(_few(docs.sparkSession, acts), F.col("id").eqNullSafe(F.col("act_id")) & (F.col("key") == F.col("act_key")), "left")
    kept = met.filter("wins is null").select("row.*")
    if acts.filter("wins").head(1):  # repeated rows that win
        one = met.filter("wins").groupBy("id", "key").agg(F.first("row").alias("row"))
        kept = kept.unionAll(one.select("row.*"))
    return kept
