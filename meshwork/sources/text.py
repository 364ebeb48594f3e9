"""Graphs as text.  A malformed line fails the read; nothing is inferred.

======================  ==================================
edge list               SRC<tab>DST
weighted edge list      SRC<tab>DST<tab>WEIGHT
adjacency list          SRC<tab>DEGREE D1 D2 ...
weighted adjacency      SRC<tab>DEGREE D1 W1 D2 W2 ...
======================  ==================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNWEIGHTED = "src long, dst long"
WEIGHTED = "src long, dst long, weight double"


def checked(edges: DataFrame) -> DataFrame:
    """edges, failing on ids that are missing or negative and on missing weights, as the rows are read."""
    bad = F.col("src").isNull() | F.col("dst").isNull() | (F.col("src") < 0) | (F.col("dst") < 0)
    if "weight" in edges.columns:
        bad = bad | F.col("weight").isNull()
    line = F.concat(F.lit("bad edge: "), *(F.concat(F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(" ")) for c in edges.columns))
    return edges.withColumn("src", F.when(bad, F.raise_error(line).cast("long")).otherwise(F.col("src")))


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, delimiter: str = "\t", recursive: bool = True) -> DataFrame:
    reader = spark.read.schema(WEIGHTED if weighted else UNWEIGHTED).option("sep", delimiter).option("mode", "FAILFAST").option("recursiveFileLookup", recursive)
    return checked(reader.csv(path))


def _number(token: Column, kind: str) -> Column:
    return token.cast(kind)  # ANSI casts fail on what is no number


def read_adjacency_list(spark: SparkSession, path: str, weighted: bool = False, vertex_delimiter: str = "\t", edge_delimiter: str = " ", recursive: bool = True) -> DataFrame:
    """One row for each edge; a line of degree 0 gives none, and its id does not count as seen."""
    quote = lambda d: "\\Q" + d + "\\E"
    lines = spark.read.option("recursiveFileLookup", recursive).text(path).filter(F.trim("value") != "")
    parts = F.split("value", quote(vertex_delimiter), 2)
    head = lines.select(parts[0].alias("s"), F.split(F.rtrim(parts[1]), quote(edge_delimiter), -1).alias("t"))
    degree = _number(F.col("t")[0], "int")
    rows = head.select(_number(F.trim("s"), "long").alias("src"), degree.alias("degree"), F.slice("t", 2, F.size("t")).alias("t"))
    each = 2 if weighted else 1
    given = F.when((F.col("degree") == 0) & (F.size(F.filter("t", lambda x: x != "")) == 0), 0).otherwise(F.size("t"))
    message = F.concat(F.lit("vertex "), F.col("src").cast("string"), F.lit(" declares "), F.col("degree").cast("string"), F.lit(" edges and has "), given.cast("string"), F.lit(f" tokens for {each} each"))
    counted = rows.withColumn("degree", F.when(given != F.col("degree") * each, F.raise_error(message).cast("int")).otherwise(F.col("degree")))
    at = F.sequence(F.lit(0), F.col("degree") - 1)
    item = lambda i: F.struct(F.get("t", i * each).cast("long").alias("dst"), *([F.get("t", i * each + 1).cast("double").alias("weight")] if weighted else []))
    edges = counted.filter("degree > 0").select("src", F.inline(F.transform(at, item)))
    return checked(edges)


def write_edge_list(edges: DataFrame, path: str, delimiter: str = "\t", mode: str = "errorifexists") -> None:
    edges.write.mode(mode).option("sep", delimiter).csv(path)


def write_adjacency_list(edges: DataFrame, path: str, vertex_delimiter: str = "\t", edge_delimiter: str = " ", mode: str = "errorifexists") -> None:
    """One line for each source, neighbours in order; with weights if the edges have any.  The format puts a source's edges in one line."""
    weighted = "weight" in edges.columns
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    item = F.struct("dst", "weight") if weighted else F.struct("dst")
    lists = edges.groupBy("src").agg(F.count("*").alias("degree"), F.array_sort(F.collect_list(item)).alias("items"))
    tokens = F.transform("items", lambda x: F.concat_ws(edge_delimiter, text(x["dst"]), *([text(x["weight"])] if weighted else [])))
    line = F.concat(text("src"), F.lit(vertex_delimiter), F.concat_ws(edge_delimiter, text("degree"), F.array_join(tokens, edge_delimiter)))
    lists.select(line.alias("value")).write.mode(mode).text(path)


def write_vector(vector: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``id<tab>value`` lines; also for degrees and labels."""
    vector.write.mode(mode).option("sep", "\t").csv(path)


def read_vector(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    return spark.read.schema(f"id long, value {kind}").option("sep", "\t").option("mode", "FAILFAST").csv(path)
