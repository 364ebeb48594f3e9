"""The programs: PageRank, random walk with restart, shortest paths, components and labels, and an example of one's own."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph
from meshwork.session import Scratch

from . import contraction, sketches
from .gimv import Context, Program, Result, run

DAMPING = 0.85
THRESHOLD = 1e-8
#: Stands for "unreachable" where a number is asked for.
UNREACHABLE = 8.988465674311579e307


def _is_vertex(source: int) -> Callable[[Context], None]:
    def check(ctx: Context) -> None:
        if not 0 <= source < ctx.num_vertices:
            raise ValueError(f"source {source} is not a vertex of 0 to {ctx.num_vertices - 1}")

    return check


def pagerank_program(damping: float, threshold: float, source: int | None, normalise: bool = True) -> Program:
    """Ranks start and teleport evenly, or at a source.  Rank of vertices without out-edges is dropped, and the end is normalised."""
    even = lambda ctx: F.lit(1.0 / max(ctx.num_vertices, 1))
    at = lambda ctx, i: even(ctx) if source is None else (i == source).cast("double")
    return Program(
        init=at,
        combine2=lambda ctx, value, degree, weight: value / degree,
        combine_all=F.sum,
        apply=lambda ctx, i, old, message: damping * F.coalesce(message, F.lit(0.0)) + (1 - damping) * at(ctx, i),
        changed=lambda ctx, old, new: F.abs(new - old) > threshold,
        scalars=lambda ctx: {"total": F.sum("value")},
        check=None if source is None else _is_vertex(source),
        finalize=lambda ctx, value: value / F.lit(ctx.scalars["total"]) if normalise and ctx.scalars.get("total") else value,
    )


def pagerank(graph: Graph, max_iter: int = -1, damping: float = DAMPING, threshold: float = THRESHOLD, **options) -> Result:
    return run(graph.unweighted(), pagerank_program(damping, threshold, None), max_iter, **options)


def random_walk(graph: Graph, source: int, max_iter: int = -1, damping: float = DAMPING, threshold: float = THRESHOLD, **options) -> Result:
    """Random walk with restart (personalised PageRank): teleports go to the source."""
    return run(graph.unweighted(), pagerank_program(damping, threshold, source), max_iter, **options)


def shortest_paths(graph: Graph, source: int, max_iter: int = -1, unreachable: str = "null", **options) -> Result:
    """Distances along weighted edges (1 each if there are no weights).  ``unreachable``: ``null`` or ``sentinel``.

    Weights may be negative; a negative cycle that can be reached never comes to rest without max_iter.
    """
    program = Program(
        init=lambda ctx, i: F.when(i == source, F.lit(0.0)),
        combine2=lambda ctx, value, degree, weight: value + weight,
        combine_all=F.min,
        apply=lambda ctx, i, old, message: F.least(old, message),  # least() leaves nulls out
        changed=lambda ctx, old, new: new.isNotNull() & (old.isNull() | (new < old)),
        sends=lambda ctx, value: value.isNotNull(),
        finalize=lambda ctx, value: F.coalesce(value, F.lit(UNREACHABLE)) if unreachable == "sentinel" else value,
        weighted=True,
        incremental=True,
        check=_is_vertex(source),
    )
    return run(graph, program, max_iter, **options)


def hops(graph: Graph, source: int, max_iter: int = -1, **options) -> Result:
    """Number of edges from the source."""
    return shortest_paths(graph.unweighted(), source, max_iter, **options)


def label_program(largest: bool = False) -> Program:
    merge, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    return Program(
        init=lambda ctx, i: i,
        combine2=lambda ctx, value, degree, weight: value,
        combine_all=merge,
        apply=lambda ctx, i, old, message: pick(old, message),
        changed=lambda ctx, old, new: (new > old) if largest else (new < old),
        kind="long",
        incremental=True,
    )


def min_label(graph: Graph, direction: str = "directed", max_iter: int = -1, **options) -> Result:
    """Smallest id that reaches a vertex (directed) or that it reaches (transposed); undirected: its component."""
    return run(graph.unweighted().directed(direction), label_program(), max_iter, **options)


def connected_components(graph: Graph, max_iter: int = -1, **options) -> Result:
    """Weakly connected components, named by their smallest id; a round a hop."""
    return min_label(graph, "undirected", max_iter, **options)


def contracted_components(graph: Graph) -> DataFrame:
    """(id, value): the same components by contraction, for graphs of great diameter; there are no rounds to count or to limit."""
    found = contraction.components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertices().join(found.withColumnRenamed("key", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("value"))


def neighbourhood(graph: Graph, max_iter: int = -1, log_size: int = 10) -> list[float]:
    """Estimated pairs (from, to) of vertices within 0, 1, 2, ... edges of each other, until no more come, by a sketch a vertex.

    A round merges the sketches of a vertex's successors into its own (sketches.py); the last one is that in which no sketch changes.  A
    sketch has 2**log_size bytes (log_size: 4 to 21), and errs by some 1.04 / sqrt(2**log_size).
    """
    if not 4 <= log_size <= 21:
        raise ValueError(f"log_size must be from 4 to 21, not {log_size}")
    scratch = Scratch(graph.edges.sparkSession)
    try:
        edges = scratch.write(graph.edges.select("src", "dst").distinct())
        n = Graph(edges).num_vertices()
        if not n:
            return [0.0]
        blocks = sketches.block_count(n, log_size)
        state = scratch.write(sketches.first(edges, n, blocks, log_size))
        pairs = [math.fsum(r.total for r in state.select("total").collect())]  # a row a block
        scratch.keep_last()
        while not 0 <= max_iter < len(pairs):
            state = scratch.write(sketches.after(state, blocks, log_size))
            scratch.keep_last()
            seen = state.select("total", "changed").collect()
            if not any(r.changed for r in seen):
                break
            pairs.append(math.fsum(r.total for r in seen))
        return pairs
    finally:
        scratch.clear()


def effective_diameter(pairs: list[float], share: float = 0.9) -> float:
    """The number of edges within which ``share`` of the pairs that are connected lie, interpolated; NaN without pairs."""
    if not pairs or not pairs[-1]:
        return math.nan
    want = share * pairs[-1]
    at = next(i for i, n in enumerate(pairs) if n >= want)
    return float(at) if at == 0 else at - 1 + (want - pairs[at - 1]) / (pairs[at] - pairs[at - 1])


def max_label(graph: Graph, max_iter: int = -1, **options) -> Result:
    """An example of a program of one's own: the largest id that reaches a vertex."""
    return run(graph.unweighted(), label_program(largest=True), max_iter, **options)


def normalised(vector: DataFrame) -> DataFrame:
    """value / sum of values; a sum of zero or an empty vector leaves values as they are."""
    total = vector.agg(F.sum("value")).head()[0]
    return vector.select("id", (F.col("value") / F.lit(total) if total else F.col("value")).alias("value"))


__all__ = ["Context", "connected_components", "contracted_components", "effective_diameter", "hops", "max_label", "min_label", "neighbourhood", "normalised", "pagerank", "random_walk", "shortest_paths"]
