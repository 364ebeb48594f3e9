"""python -m meshwork.cli COMMAND: programs over text graphs, with the results as ``id<tab>value`` lines.

    partition INPUT OUTPUT -p BLOCKS [--threshold N] [--direction directed|undirected|transposed]
    pagerank  INPUT OUTPUT [--max-iter N] [--damping A] [--epsilon E] [--source ID]     (a source makes it a random walk)
    sssp      INPUT OUTPUT --source ID [--max-iter N] [--sentinel]
    cc        INPUT OUTPUT [--max-iter N]
    degree    INPUT OUTPUT [--kind in|out|total]

INPUT is an edge list, with ``--format adjlist`` an adjacency list, or with ``--format blocks`` what partition has written.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshwork.operators import blocks
from meshwork.operators.graph import Graph
from meshwork.plans import programs
from meshwork.sources import text


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meshwork", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("input")
    common.add_argument("output")
    common.add_argument("--format", choices=("edgelist", "adjlist", "blocks"), default="edgelist")
    common.add_argument("--weighted", action="store_true")
    common.add_argument("--delimiter", default="\t", help="between the ids of an edge, or the vertex and its list")
    common.add_argument("--edge-delimiter", default=" ", help="between the entries of an adjacency list")
    common.add_argument("--threshold", type=int, default=blocks.DENSE_THRESHOLD, help="out-degree from which a vertex is dense")
    for name in ("partition", "pagerank", "sssp", "cc", "degree"):
        c = commands.add_parser(name, parents=[common])
        if name in ("pagerank", "sssp", "cc"):
            c.add_argument("--max-iter", type=int, default=-1)
        if name in ("pagerank", "sssp"):
            c.add_argument("--source", type=int, required=name == "sssp")
        if name == "pagerank":
            c.add_argument("--damping", type=float, default=programs.DAMPING)
            c.add_argument("--epsilon", type=float, default=programs.THRESHOLD)
        if name == "sssp":
            c.add_argument("--sentinel", action="store_true", help="a number for vertices that cannot be reached")
        if name == "degree":
            c.add_argument("--kind", choices=("in", "out", "total"), default="total")
        if name == "partition":
            c.add_argument("-p", "--blocks", type=int, required=True)
            c.add_argument("--direction", choices=("directed", "undirected", "transposed"), default="directed")
    return top


def load(spark: SparkSession, a: argparse.Namespace) -> Graph:
    if a.format == "blocks":
        return blocks.read_blocks(spark, a.input)
    weighted = a.weighted or a.command == "sssp"
    if a.format == "adjlist":
        return Graph(text.read_adjacency_list(spark, a.input, weighted, a.delimiter, a.edge_delimiter))
    return Graph(text.read_edge_list(spark, a.input, weighted, a.delimiter))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"meshwork {a.command}").getOrCreate()
    graph = load(spark, a)
    if a.command == "partition":
        blocks.write_blocks(graph.directed(a.direction), a.output, a.blocks, a.threshold)
        return 0
    if a.command == "degree":
        text.write_vector(graph.degrees(a.kind), a.output)
        return 0
    if a.command == "pagerank":
        options = {"max_iter": a.max_iter, "damping": a.damping, "threshold": a.epsilon, "dense_threshold": a.threshold}
        result = programs.pagerank(graph, **options) if a.source is None else programs.random_walk(graph, a.source, **options)
    elif a.command == "sssp":
        result = programs.shortest_paths(graph, a.source, a.max_iter, "sentinel" if a.sentinel else "null", dense_threshold=a.threshold)
    else:
        result = programs.connected_components(graph, a.max_iter, dense_threshold=a.threshold)
    vector = result.vector
    if a.command == "sssp" and not a.sentinel:
        vector = vector.select("id", F.coalesce(F.col("value").cast("string"), F.lit("inf")).alias("value"))
    text.write_vector(vector, a.output)
    print(json.dumps({"iterations": result.iterations, "converged": result.converged, "job_ms": [round(x) for x in result.job_ms]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
