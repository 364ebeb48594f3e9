"""Generalised iterated matrix-vector multiplication as a loop over DataFrames.

A *program* is a set of Column builders: how a vertex begins, what it sends along an edge, how messages to a vertex
are merged, what becomes of its old value and the merged message, and what counts as a change.  Rounds are synchronous;
a vertex that does not count as changed keeps its old value; the loop ends when none changed or ``max_iter`` rounds are done
(at least one; -1: no limit).

Plan of a round.  The vector (id, value, degree, changed_at) is the only thing that moves:

* sparse sources: edges stay where they are, hash-partitioned by source and cached; each vertex has a *self row* among them
  that carries its old value on, so one join and one aggregation make a round and the plan grows by one copy a round;
* dense sources (out-degree at or over the threshold): their edges stay dealt evenly, as no hash puts a hub's edges into
  one task, and get the few dense entries of the vector by broadcast.  Their number is checked; over ``max_broadcast`` they
  are joined by a shuffle as the others are.

Messages are merged by partial aggregation before they are shuffled, so a vertex of great in-degree does not skew a round.
The lineage is cut by checkpoints in the shared folder, after several rounds at once where the plan stays linear.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.ids import is_dense
from meshwork.operators.graph import Graph
from meshwork.session import shared_folder

UNROLL = 4
MAX_BROADCAST = 2_000_000
FRONTIER_SHARE = 0.02
FRONTIER_FROM = 500_000


@dataclass(frozen=True)
class Context:
    """What the builders may use.  iteration counts from 1 (0 in init, the last one in finalize); max_iter is None without a limit."""

    num_vertices: int
    params: dict = field(default_factory=dict)
    scalars: dict = field(default_factory=dict)
    iteration: int = 0
    max_iter: int | None = None


@dataclass(frozen=True)
class Program:
    """Column builders; each takes the context first.

    init(ctx, id); combine2(ctx, value, degree, weight); combine_all(message) is an aggregate; apply(ctx, id, old, message) gives
    the candidate, with a null message if none came; changed(ctx, old, new); sends(ctx, value) tells which vertices send;
    scalars(ctx) are aggregates of the last vector, for finalize(ctx, value).
    """

    init: Callable[[Context, Column], Column]
    combine2: Callable[[Context, Column, Column, Column], Column]
    combine_all: Callable[[Column], Column]
    apply: Callable[[Context, Column, Column, Column], Column]
    changed: Callable[[Context, Column, Column], Column]
    sends: Callable[[Context, Column], Column] | None = None
    scalars: Callable[[Context], dict[str, Column]] | None = None
    finalize: Callable[[Context, Column], Column] = lambda ctx, value: value
    weighted: bool = False
    kind: str = "double"
    #: Only vertices that changed in the round before send; for programs whose merge is idempotent (min, max) and whose
    #: values move one way, as what the others have to say has arrived already.
    incremental: bool = False
    #: Raises an error if the program does not fit the graph.
    check: Callable[[Context], None] | None = None
    #: Called before the first round, and after each job of rounds with the vector (id, value, degree, dense, changed_at) as it then is.
    before: Callable[[Context, DataFrame], None] | None = None
    after: Callable[[Context, DataFrame], None] | None = None


@dataclass(frozen=True)
class Job:
    """Rounds made at once: the first one, their number, the time they took and how many vertices changed in the last one."""

    first: int
    rounds: int
    ms: float
    changed: int


@dataclass
class Result:
    """The vector (id, value), how many rounds made it, whether it came to rest, and the jobs of rounds."""

    vector: DataFrame
    iterations: int
    converged: bool
    jobs: list[Job]
    scalars: dict

    @property
    def job_ms(self) -> list[float]:
        return [job.ms for job in self.jobs]

    @property
    def iteration_ms(self) -> dict[int, float]:
        """Milliseconds by round; rounds that were made in one job (at most ``unroll``) share its time evenly."""
        return {job.first + i: job.ms / job.rounds for job in self.jobs for i in range(job.rounds)}


def checkpoint(df: DataFrame) -> DataFrame:
    """A copy in the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cutoff(degrees: DataFrame, threshold: int, most: int) -> int | None:
    """The out-degree from which vertices are handled as dense: the threshold, or, if more than ``most`` vertices reach it, the
    least power of two that few enough do; None if no vertex is dense, or too many whatever the cut: then more than ``most`` vertices
    are within a factor of two of the greatest degree, so hashing their edges by source deals them evenly as it is."""
    if threshold < 0:
        return None
    power = F.floor(F.log2(F.col("degree").cast("double"))).cast("int")
    classes = {r.power: r.n for r in degrees.filter(is_dense(F.col("degree"), threshold)).groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    if 0 < sum(classes.values()) <= most:
        return threshold
    cut, total = None, 0
    for p in sorted(classes, reverse=True):
        total += classes[p]
        if total > most:
            break
        cut = 1 << p
    return cut


class Layout:
    """Edges and self rows in the form that rounds use; cached until close()."""

    def __init__(self, graph: Graph, program: Program, threshold: int, max_broadcast: int):
        spark: SparkSession = graph.edges.sparkSession
        weight = F.col("weight") if program.weighted and graph.weighted else F.lit(1.0)
        edges = graph.edges.select("src", "dst", weight.alias("weight")) if program.weighted else graph.edges.select("src", "dst", F.lit(None).cast("double").alias("weight"))
        # out-degrees, dense vertices and the number of vertices come from one pass over the edges
        degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.max("dst").alias("far")).persist(StorageLevel.MEMORY_AND_DISK)
        self.cached = [degrees]
        self.n = degrees.agg(F.max(F.greatest("id", "far")) + 1).head()[0] or 0
        cut = cutoff(degrees, threshold, max_broadcast)
        self.hybrid = cut is not None
        flag = is_dense(F.col("degree"), cut) if self.hybrid else F.lit(False)
        hubs = degrees.filter(flag).select(F.col("id").alias("src"))
        selves = spark.range(self.n).join(degrees, "id", "left").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("double").alias("weight"), F.lit(True).alias("self"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce(flag, F.lit(False)).alias("dense"))
        rest = edges
        if self.hybrid:
            few = F.broadcast(hubs)  # at most max_broadcast ids
            self.dense = self._keep(edges.join(few, "src", "left_semi"))
            rest = edges.join(few, "src", "left_anti")
        rows = rest.select("src", "dst", "weight", F.lit(False).alias("self"), F.lit(0).cast("long").alias("degree"), F.lit(False).alias("dense"))
        self.rows = self._keep(rows.unionAll(selves).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src").sortWithinPartitions("src"))

    def _keep(self, df: DataFrame) -> DataFrame:
        self.cached.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.cached[-1]

    def close(self) -> None:
        for df in self.cached:
            df.unpersist()


def superstep(layout: Layout, vector: DataFrame, program: Program, ctx: Context, iteration: int) -> DataFrame:
    """The vector after one more round."""
    state = vector.select("id", "value", F.col("degree").alias("out"), "changed_at")
    rows = layout.rows.join(state, F.col("src") == F.col("id")).select("dst", "weight", "self", "degree", "dense", "id", "value", "out", "changed_at")
    sent = program.combine2(ctx, F.col("value"), F.col("out"), F.col("weight"))
    if program.sends is not None:
        sent = F.when(program.sends(ctx, F.col("value")), sent)
    awake = F.col("changed_at") == iteration - 1 if program.incremental else F.lit(True)
    rows = rows.filter(F.col("self") | awake)
    mine = lambda c: F.when(F.col("self"), F.col(c))
    messages = rows.select(F.col("dst").alias("to"), F.when(~F.col("self"), sent).alias("message"), mine("value").alias("old"), mine("degree").alias("degree"), mine("dense").alias("dense"), mine("changed_at").alias("changed_at"))
    if layout.hybrid:
        hubs = F.broadcast(vector.filter(F.col("dense") & awake).select("id", "value", F.col("degree").alias("out")))
        none = {c: F.lit(None).cast(messages.schema[c].dataType).alias(c) for c in ("old", "degree", "dense", "changed_at")}
        heavy = layout.dense.join(hubs, F.col("src") == F.col("id")).select(F.col("dst").alias("to"), sent.alias("message"), *none.values())
        messages = messages.unionAll(heavy)
    merged = messages.groupBy(F.col("to").alias("id")).agg(program.combine_all(F.col("message")).alias("message"), F.max("old").alias("old"), F.max("degree").alias("degree"), F.bool_or("dense").alias("dense"), F.max("changed_at").alias("changed_at"))
    candidate = program.apply(ctx, F.col("id"), F.col("old"), F.col("message")).cast(program.kind)
    applied = merged.withColumn("new", candidate)
    moved = F.coalesce(program.changed(ctx, F.col("old"), F.col("new")), F.lit(False))
    return applied.select("id", F.when(moved, F.col("new")).otherwise(F.col("old")).alias("value"), "degree", "dense", F.when(moved, iteration).otherwise(F.col("changed_at")).alias("changed_at"))


def frontier_step(layout: Layout, vector: DataFrame, program: Program, ctx: Context, iteration: int) -> DataFrame:
    """The same round of an incremental program when few vertices changed: they, and then their messages, are broadcast, so neither
    the edges nor the vector are shuffled.  The caller has checked the number of both."""
    senders = vector.filter(F.col("changed_at") == iteration - 1).select("id", "value", F.col("degree").alias("out"))
    sent = program.combine2(ctx, F.col("value"), F.col("out"), F.col("weight"))
    if program.sends is not None:
        sent = F.when(program.sends(ctx, F.col("value")), sent)
    edges = layout.rows.filter(~F.col("self")).select("src", "dst", "weight")
    if layout.hybrid:
        edges = edges.unionAll(layout.dense.select("src", "dst", "weight"))
    messages = edges.join(F.broadcast(senders), F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(program.combine_all(sent).alias("message"))
    merged = vector.join(F.broadcast(messages), F.col("id") == F.col("to"), "left")
    applied = merged.withColumn("new", program.apply(ctx, F.col("id"), F.col("value"), F.col("message")).cast(program.kind))
    moved = F.coalesce(program.changed(ctx, F.col("value"), F.col("new")), F.lit(False))
    return applied.select("id", F.when(moved, F.col("new")).otherwise(F.col("value")).alias("value"), "degree", "dense", F.when(moved, iteration).otherwise(F.col("changed_at")).alias("changed_at"))


def initial(layout: Layout, program: Program, ctx: Context) -> DataFrame:
    own = layout.rows.filter("self").select(F.col("src").alias("id"), "degree", "dense")
    return own.select("id", program.init(ctx, F.col("id")).cast(program.kind).alias("value"), "degree", "dense", F.lit(0).alias("changed_at"))


def run(graph: Graph, program: Program, max_iter: int = -1, dense_threshold: int = 100, params: dict | None = None, unroll: int = UNROLL, max_broadcast: int = MAX_BROADCAST, frontier_share: float = FRONTIER_SHARE, frontier_from: int = FRONTIER_FROM) -> Result:
    """Rounds of a program.  An empty graph gives an empty vector.

    Once the edges of the vertices that changed are at most ``frontier_share`` of the vertices and at most ``max_broadcast``, an incremental
    program goes on by frontier_step(), a round at a time; not on graphs of fewer than ``frontier_from`` vertices, where several rounds
    in one job are faster than what they shuffle is slow.
    """
    if program.weighted and not graph.weighted:
        graph = Graph(graph.edges.withColumn("weight", F.lit(1.0)))
    layout = Layout(graph, program, dense_threshold, max_broadcast)
    try:
        limit = None if max_iter < 0 else max(1, max_iter)
        ctx = Context(layout.n, dict(params or {}), max_iter=limit)
        if program.check is not None:
            program.check(ctx)
        vector, done, jobs, converged, few = initial(layout, program, ctx), 0, [], False, False
        if program.before is not None:
            program.before(ctx, vector)
        at_once = 1 if layout.hybrid else max(1, unroll)  # the hybrid round uses the vector twice; two at once are no faster
        while limit is None or done < limit:
            began = time.monotonic()
            steps = 1 if few else at_once if limit is None else min(at_once, limit - done)
            for i in range(steps):
                at = done + i + 1
                vector = (frontier_step if few else superstep)(layout, vector, program, replace(ctx, iteration=at), at)
            vector = checkpoint(vector)
            new = F.col("changed_at") == done + steps
            seen = vector.agg(F.max("changed_at").alias("last"), F.count_if(new).alias("changed"), F.coalesce(F.sum(F.when(new, F.col("degree"))), F.lit(0)).alias("edges")).head()
            jobs.append(Job(done + 1, steps, 1000 * (time.monotonic() - began), seen.changed))
            if program.after is not None:
                program.after(replace(ctx, iteration=done + steps), vector)
            if seen.last is None or seen.last < done + steps:
                # a round without change changes nothing ever after
                done, converged = max((seen.last or 0), done) + 1, True
                break
            done += steps
            few = program.incremental and layout.n >= frontier_from and seen.changed + seen.edges <= min(max_broadcast, frontier_share * layout.n)
        wanted = program.scalars(ctx) if program.scalars else {}
        scalars = vector.agg(*(c.alias(name) for name, c in wanted.items())).head().asDict() if wanted else {}
        ctx = replace(ctx, scalars=scalars, iteration=done)
        out = vector.select("id", program.finalize(ctx, F.col("value")).cast(program.kind).alias("value"))
        return Result(out, done, converged, jobs, scalars)
    finally:
        layout.close()
