"""Connected components by contraction: a number of rounds that grows with the logarithm of a component's size, not with its diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.session import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key that each key of edges (a, b) reaches; keys whose only edges are self-loops are left out.

    Every node takes the least of its neighbours and itself, looks one step further, and edges are
    rewritten to where their ends went and made distinct, so each round joins fewer of them.  An edge of a node to its least
    neighbour is an edge like the others, so what hangs together stays so.  Labels come from the rounds' tables, last to first.
    Least neighbours are aggregated before they are shuffled; a hub's edges in a join are split by AQE.  Chains whose keys are in
    order are the slow case (two nodes of each a round); keys that are hashes, or of no order along the edges, are not.
    """
    scratch = Scratch(edges.sparkSession)
    ordered = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    left, steps = scratch.write(edges.select(*ordered).filter("a <> b").distinct()), []
    while left.head(1):
        ends = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.write(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("to")))
        further = up.select(F.col("key").alias("to"), F.col("to").alias("far"))
        step = scratch.write(up.join(further, "to").select("key", F.col("far").alias("to")))
        went = lambda end: step.select(F.col("key").alias(end), F.col("to").alias(f"{end}_to"))  # noqa: E731, B023
        moved = left.join(went("a"), "a").select("b", "a_to").distinct().join(went("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = scratch.write(moved.filter("a <> b").select(*ordered).distinct())
        steps.append(step)
    labels = steps.pop().withColumnRenamed("to", "label") if steps else left.select(F.col("a").alias("key"), F.col("b").alias("label"))
    for step in reversed(steps):
        then = labels.select(F.col("key").alias("to"), "label")
        labels = step.join(then, "to", "left").select("key", F.coalesce("label", "to").alias("label"))
    labels = labels.checkpoint(eager=True)
    scratch.clear()
    return labels
