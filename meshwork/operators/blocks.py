"""Matrix blocks: the adjacency matrix cut into p x p blocks by ``id mod p``, columns told apart by out-degree.

A column is a source vertex.  Its entry in a block has its local id, its whole out-degree (over all blocks), and the
local ids of the rows it reaches in the block.  Columns of a degree of at least the threshold are dense, the others sparse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.ids import block_id, global_id, is_dense, local_id

from .graph import Graph

KEYS = ("region", "row_block", "col_block")
DENSE_THRESHOLD = 100


def with_blocks(edges: DataFrame, p: int) -> DataFrame:
    """edges with row_block, row, col_block, col."""
    src, dst = F.col("src"), F.col("dst")
    return edges.withColumns({"row_block": block_id(dst, p), "row": local_id(dst, p), "col_block": block_id(src, p), "col": local_id(src, p)})


def matrix_columns(graph: Graph, p: int, threshold: int = DENSE_THRESHOLD) -> DataFrame:
    """(region, row_block, col_block, col, degree, rows[, weights]); rows are in order."""
    degrees = graph.out_degrees().select(F.col("id").alias("src"), "degree")
    item = F.struct("row", "weight") if graph.weighted else F.struct("row")
    # entries are gathered before the degrees join them: one row a column and block, so a source of great degree stays apart
    entries = with_blocks(graph.edges, p).groupBy("src", "row_block", "col_block", "col").agg(F.array_sort(F.collect_list(item)).alias("items"))
    region = F.when(is_dense(F.col("degree"), threshold), "dense").otherwise("sparse")
    weights = [F.col("items.weight").alias("weights")] if graph.weighted else []
    return entries.join(degrees, "src").select(region.alias("region"), "row_block", "col_block", "col", "degree", F.col("items.row").alias("rows"), *weights)


def block_stats(columns: DataFrame) -> DataFrame:
    """Entries (num_rows) and columns (num_cols) of each block that has any."""
    return columns.groupBy(*KEYS).agg(F.sum(F.size("rows")).cast("long").alias("num_rows"), F.count("*").alias("num_cols"))


def dense_vertices(graph: Graph, threshold: int = DENSE_THRESHOLD) -> DataFrame:
    return graph.out_degrees().filter(is_dense(F.col("degree"), threshold))


def write_blocks(graph: Graph, path: str, p: int, threshold: int = DENSE_THRESHOLD, mode: str = "errorifexists") -> None:
    """Parquet under ``path``/columns by region and block, ``path``/stats and ``path``/meta."""
    spark = graph.edges.sparkSession
    columns = matrix_columns(graph, p, threshold)
    # a block in one place, unless it is so large that AQE splits it
    columns.hint("rebalance", *(F.col(c) for c in KEYS)).write.mode(mode).partitionBy(*KEYS).parquet(f"{path}/columns")
    block_stats(spark.read.parquet(f"{path}/columns")).write.mode(mode).parquet(f"{path}/stats")
    meta = graph.num_vertices_frame().select(F.coalesce("num_vertices", F.lit(0)).alias("num_vertices"), F.lit(p).alias("p"), F.lit(threshold).alias("threshold"), F.lit(graph.weighted).alias("weighted"))
    meta.write.mode(mode).parquet(f"{path}/meta")


def read_columns(spark: SparkSession, path: str, **blocks: int | str) -> DataFrame:
    """Columns of a block layout; region=, row_block=, col_block= read only those folders."""
    found = spark.read.parquet(f"{path}/columns")
    for name, value in blocks.items():
        if name not in KEYS:
            raise ValueError(f"blocks are chosen by {', '.join(KEYS)}")
        found = found.filter(F.col(name) == value)
    return found


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/stats")


def edges_of(columns: DataFrame, p: int) -> DataFrame:
    """The edges that columns were made from."""
    src = global_id(F.col("col"), F.col("col_block"), p)
    weighted = "weights" in columns.columns
    item = F.arrays_zip("rows", "weights") if weighted else F.arrays_zip("rows")
    each = columns.select(src.alias("src"), "row_block", F.explode(item).alias("x"))
    rest = [F.col("x.weights").alias("weight")] if weighted else []
    return each.select("src", global_id(F.col("x.rows"), F.col("row_block"), p).alias("dst"), *rest)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(num_vertices, p, threshold, weighted), one row."""
    return spark.read.parquet(f"{path}/meta")


def read_blocks(spark: SparkSession, path: str) -> Graph:
    meta = read_meta(spark, path).head()
    return Graph(edges_of(read_columns(spark, path), meta.p))
