"""Sharding: balanced label propagation that keeps linked documents in one shard while shards stay even.

Equal texts are linked, and so are the documents of an optional table of edges.  Every document begins in the shard of its hash.
First equal texts come together: in each round the documents of a group look at where the others are, and
those outside the group's largest shard ask to move there.  A shard takes movers up to its quota, those with most to gain
first.  As documents of a group and shard are alike, the state is one row for each group and shard (at most as
many rows a group as there are shards), however large a group is; only groups of two or more take part.  A group that
fits nowhere moves in part and fills one shard after the other.  Rounds go on until no move is accepted.
Then, if there are edges, groups follow their neighbours: each round joins edges to the shards of the neighbours, and a group asks for the shard
that holds most of them; as many move from one shard to another as move the other way, and into room, until no more edges come together.
In the end shards are filled to exact quotas: linked documents stay where they are up to the quota, and documents without links, which cost no edge anywhere, fill the rest.

Numbers per shard, or pair of shards (some thousands), are all that reaches the driver.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, checkpoint, partitions, ranked

_CLASSES = 64  # gains are ordered by their power of two
_IDLE = 3  # rounds without a move that end the loop: which groups move is by chance where not all can


def _unit(*columns: str | Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)).cast("double") / float(1 << 30)


def _accepted(moves: DataFrame, room: list[float]) -> Column:
    """The share of the movers of a class that their target takes: all of the best classes, then what there is room for."""
    demand = {(r.target, r.gain): r.n for r in moves.groupBy("target", "gain").agg(F.sum("n").alias("n")).collect()}
    share = []
    for t, free in enumerate(room):
        row, left = [0.0] * _CLASSES, max(0.0, free)
        for g in range(_CLASSES - 1, -1, -1):
            if n := demand.get((t, g), 0):
                row[g] = min(1.0, left / n)
                left -= n * row[g]
        share += row
    table = F.split(F.lit(",".join(map(repr, share))), ",").cast("array<double>")
    return F.get(table, F.col("target") * _CLASSES + F.col("gain"))


def propagate(cells: DataFrame, shards: int, capacity: float) -> DataFrame:
    """cells (group, shard, n) after rounds until no move is accepted; documents are moved, none are made or lost.

    A group that fits somewhere moves as a whole and never again.  One that fits nowhere moves from its smaller cells into its largest
    that has room, so the squares of its cells add up to more after each move: rounds come to an end.
    """
    group = Window.partitionBy("group")
    at = idle = 0
    while True:
        load = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0.0, capacity - load.get(s, 0)) for s in range(shards)]
        free = F.get(F.array(*map(F.lit, room)), F.col("shard"))
        sized = cells.withColumn("total", F.sum("n").over(group))
        # the neighbours' largest shard that has room for the rest; else the emptiest shard; else the largest that has any room
        fits = (F.col("total") - F.col("n")) <= free
        order = F.struct("n", F.xxhash64("group", "shard").alias("tie"))
        whole = F.col("total") <= max(room, default=0.0)
        emptiest = F.when(whole, F.lit(room.index(max(room))))
        best = F.max_by(F.when(fits, F.col("shard")), F.when(fits, order)).over(group)
        open_ = free >= 1
        part = F.max_by(F.when(open_, F.col("shard")), F.when(open_, order)).over(group)
        seen = sized.withColumns({"best": F.coalesce(best, emptiest), "part": part, "top": F.max(F.when(open_, order)).over(group)})
        # groups that fit nowhere come last: they are cut anyway, and take only what room the others leave
        large = F.col("best").isNull()
        gain = F.when(large, 0).otherwise(F.least(F.floor(F.log2(F.max("n").over(group).cast("double"))) + 1, F.lit(_CLASSES - 1))).cast("int")
        seen = seen.withColumns({"gain": gain, "target": F.coalesce("best", "part"), "large": large})
        seen = checkpoint(seen.withColumn("moves", F.coalesce((F.col("shard") != F.col("target")) & (~F.col("large") | (order < F.col("top"))), F.lit(False))))
        moves = seen.filter("moves")
        if not moves.head(1):
            return cells
        share = _accepted(moves, room)
        # a part of a cell is rounded up or down by chance, so that many small cells fill the room too
        some = F.least(F.col("n"), F.floor(F.col("n") * share + _unit("group", "shard", F.lit(at))))
        moved = F.when(~F.col("moves"), F.lit(0)).when(F.col("large"), some).when(_unit("group", F.lit(at)) < share, F.col("n")).otherwise(F.lit(0)).cast("long")
        after = checkpoint(seen.withColumn("moved", moved))
        at += 1
        if not after.filter("moved > 0").head(1):
            idle += 1
            if idle == _IDLE:
                return cells
            continue
        idle = 0
        stay = after.select("group", "shard", (F.col("n") - F.col("moved")).alias("n"))
        come = after.select("group", F.col("target").alias("shard"), F.col("moved").alias("n"))
        cells = checkpoint(stay.unionAll(come).filter("n > 0").groupBy("group", "shard").agg(F.sum("n").alias("n")))


def _exchanged(moves: DataFrame, room: list[float], shards: int) -> Column:
    """The share of those who ask to go from shard to target that may: as many as come back, then what there is room for."""
    demand = {(r.shard, r.target): r.n for r in moves.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}
    taken = {(i, j): float(min(n, demand.get((j, i), 0))) for (i, j), n in demand.items()}
    for j, free in enumerate(room):
        wait = sum(n - taken[i, t] for (i, t), n in demand.items() if t == j)
        part = min(1.0, max(0.0, free) / wait) if wait else 0.0
        for i in range(shards):
            if (i, j) in demand:
                taken[i, j] += part * (demand[i, j] - taken[i, j])
    share = [taken.get((i, j), 0.0) / demand.get((i, j), 1) for i in range(shards) for j in range(shards)]
    return F.get(F.split(F.lit(",".join(map(repr, share))), ",").cast("array<double>"), F.col("shard") * shards + F.col("target"))


def follow(cells: DataFrame, edges: DataFrame, shards: int, capacity: float, slack: float = 0.5) -> DataFrame:
    """cells (group, shard, n) after groups have moved towards their neighbours; edges: (group, other, weight), in both directions.

    While they move, a shard may hold more than its even part by ``slack``; without it propagation ends early, with more edges cut
    than the documents cut that are over the quota in the end.

    A group in several shards, too large for one, attracts but stays.  Half of the groups, by a hash of the round, may ask in a round, so
    that neighbours don't swap places for ever.  The best state, by the weight of edges within shards, is returned, once some
    rounds have not bettered it.
    """
    scratch = Scratch(cells.sparkSession)
    edges, cells = scratch.write(edges), scratch.write(cells)
    best, best_kept, at, idle = cells, -1.0, 0, 0
    while True:
        pull = edges.join(cells.select(F.col("group").alias("other"), "shard", "n"), "other").groupBy("group", "shard").agg(F.sum(F.col("weight") * F.col("n")).alias("pull"))
        whole = cells.groupBy("group").agg(F.count("*").alias("cells"), F.first("shard").alias("shard"), F.sum("n").alias("n")).filter("cells = 1").drop("cells")
        ask = pull.select("group", F.col("shard").alias("to"), "pull").join(whole, "group")
        own = F.col("to") == F.col("shard")
        order = F.struct("pull", own.alias("own"), F.xxhash64("group", "to").alias("tie"))
        ask = ask.groupBy("group", "shard", "n").agg(F.max_by("to", order).alias("target"), F.coalesce(F.sum(F.when(own, F.col("pull"))), F.lit(0.0)).alias("kept"))
        ask = scratch.write(ask)
        kept = ask.agg(F.sum(F.col("kept") * F.col("n"))).head()[0] or 0.0
        if kept > best_kept:
            best, best_kept, idle = cells, kept, 0
        else:
            idle += 1
        moves = ask.filter((F.col("target") != F.col("shard")) & (_unit("group", F.lit(at), F.lit("half")) < 0.5))
        if idle == _IDLE or not ask.filter("target <> shard").head(1):
            break
        load = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        share = _exchanged(moves, [max(0.0, (1 + slack) * capacity - load.get(s, 0)) for s in range(shards)], shards)
        gone = moves.filter(_unit("group", F.lit(at)) < share).select("group", "target")
        cells = scratch.write(cells.join(gone, "group", "left").select("group", F.coalesce("target", "shard").alias("shard"), "n"))
        at += 1
    best = checkpoint(best)
    scratch.clear()
    return best


def _fill(rank: Column, label: Column, linked: list[int], singles: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot from the place in the order (label, group): quotas differ by one at most."""
    total = sum(linked) + singles
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    kept = [min(a, b) for a, b in zip(linked, quota, strict=True)]
    start, over, free = [0], [0], [0]
    for s in range(shards):
        start.append(start[-1] + linked[s])
        over.append(over[-1] + linked[s] - kept[s])
        free.append(free[-1] + quota[s] - kept[s])
    of = lambda values, at: F.get(F.array(*(F.lit(int(v)).cast("long") for v in values)), at)
    within = rank - of(start, label)
    stays = (label < shards) & (within < of([*kept, 0], label))
    # those without a place wait in line: first what is over the quotas, then documents without links
    place = of(over, label) + within - of([*kept, 0], label)
    ends = F.array(*(F.lit(int(v)).cast("long") for v in free[1:]))
    shard = F.when(stays, label).otherwise(F.size(F.filter(ends, lambda e: e <= place))).cast("int")
    slot = F.when(stays, within).otherwise(of(kept, shard) + place - of(free, shard))
    return shard, slot.cast("long")


def _labelled(placed: DataFrame, cells: DataFrame, shards: int, total: int) -> DataFrame:
    """placed with the label of each document: the shard of its cell, or ``shards`` if it has no links.

    Documents are numbered by group, so a cell (group, shard, n, first) is a run of numbers.  Runs and documents are dealt by
    number, in chunks of equal size however large a group is, and a sweep hands each document the run that is open.
    """
    chunk = max(1, -(-total // (4 * partitions(placed.sparkSession))))
    of = lambda c: F.call_function("div", F.col(c) if isinstance(c, str) else c, F.lit(chunk))
    ends = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = cells.withColumn("high", F.col("first") + F.sum("n").over(ends)).withColumn("low", F.col("high") - F.col("n"))
    parts = runs.select("shard", "low", "high", F.explode(F.sequence(of("low"), of(F.col("high") - 1))).alias("chunk"))
    none = F.lit(None).cast(placed.schema["row"].dataType).alias("row")
    blank = lambda at, kind, label: [F.col("chunk"), at.alias("at"), F.lit(kind).alias("kind"), label.cast("int").alias("label"), none, *(F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("size", "text_crc32", "group"))]
    opens = parts.select(*blank(F.greatest(F.col("low"), F.col("chunk") * chunk), 1, F.col("shard")))
    closes = parts.select(*blank(F.col("high"), 0, F.lit(shards))).filter((F.col("at") < (F.col("chunk") + 1) * chunk))
    rows = placed.select(of("at").alias("chunk"), "at", F.lit(2).alias("kind"), F.lit(None).cast("int").alias("label"), "row", "size", "text_crc32", "group")
    sweep = Window.partitionBy("chunk").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.unionAll(opens).unionAll(closes).withColumn("label", F.coalesce(F.last("label", ignorenulls=True).over(sweep), F.lit(shards)))
    return swept.filter("kind = 2").select("row", "size", "text_crc32", "group", "at", "label")


def _group_edges(edges: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """(group, other, weight) in both directions, of edges (a, b) between keys."""
    of = base.select(F.col("row")[key].alias("key"), "group").filter("key is not null").distinct()
    ends = edges.select("a", "b").join(of.select(F.col("key").alias("a"), F.col("group").alias("x")), "a").join(of.select(F.col("key").alias("b"), F.col("group").alias("y")), "b").filter("x <> y")
    both = ends.select(F.col("x").alias("group"), F.col("y").alias("other")).unionAll(ends.select(F.col("y").alias("group"), F.col("x").alias("other")))
    return both.groupBy("group", "other").agg(F.count("*").cast("double").alias("weight"))


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", keys: tuple[str, ...] = ("doc_id",), edges: DataFrame | None = None) -> DataFrame:
    """keys, size (UTF-8 bytes of the text and 1), text_crc32, law (``rows``), shard, slot (from 0, without gaps).

    Numbers of rows differ by one at most between shards.  Equal texts are linked; null counts as the empty text.  ``edges`` (a, b) links
    documents by the first of their keys; edges of keys that are null or of no document are left out, repeated ones weigh more.
    A repeated row is a document of its own; null keys, fewer rows than shards and an empty table are fine.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = checkpoint(docs.select(F.struct(*(F.col(c) for c in keys)).alias("row"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.md5(t.cast("binary")).alias("group")))
    placed = ranked(base.withColumn("tie", F.xxhash64("row")), "group", "tie", name="at")
    first = F.pmod(F.xxhash64("row", "at"), F.lit(shards)).cast("int")
    counted = placed.groupBy("group", first.alias("shard")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    everywhere = Window.partitionBy("group")  # at most as many rows as shards
    counted = counted.withColumns({"total": F.sum("n").over(everywhere), "first": F.min("first").over(everywhere)})
    if edges is None:
        counted = checkpoint(counted.filter("total > 1"))
    else:
        links = checkpoint(_group_edges(edges, base, keys[0]))
        ends = links.select("group", F.lit(True).alias("linked")).distinct()
        counted = checkpoint(counted.join(ends, "group", "left").filter("total > 1 or linked"))
    total = placed.count()
    cells = propagate(counted.select("group", "shard", "n"), shards, total / shards)
    if edges is not None:
        cells = follow(cells, links, shards, total / shards)
    labelled = _labelled(placed, cells.join(counted.groupBy("group").agg(F.min("first").alias("first")), "group"), shards, total)
    ordered = ranked(labelled, "label", "group", "at", name="place")
    load = {r.shard: int(r.n) for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    linked = [load.get(s, 0) for s in range(shards)]
    shard, slot = _fill(F.col("place"), F.col("label"), linked, total - sum(linked), shards)
    out = ordered.withColumn("shard", shard).withColumn("slot", slot)
    return out.select(*(F.col("row")[c].alias(c) for c in keys), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot")
