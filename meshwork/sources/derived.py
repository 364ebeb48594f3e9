"""Graphs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_sequence(spark: SparkSession, sf_dir: str, least_quantity: float | None = None) -> Graph:
    """From part to part along the lines of an order; weight is the quantity of the first line."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").alias("weight"))
    rows = rows.filter(F.col("dst").isNotNull())
    return Graph.of(rows if least_quantity is None else rows.filter(F.col("weight") >= least_quantity))


def part_hi(spark: SparkSession, sf_dir: str) -> Graph:
    return part_sequence(spark, sf_dir, 46.0)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """From supplier to part; parts' ids follow the suppliers'."""
    first = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey") + 1).head()[0]
    return Graph.of(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + first).alias("dst"), F.col("l_quantity").alias("weight")))


def event_sessions(spark: SparkSession, sf_dir: str, gap_seconds: int = 7200) -> Graph:
    """From event to next event of a user within the gap; weight is the gap in seconds."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.select(F.col("event_id").alias("src"), F.lead("event_id").over(order).alias("dst"), ((F.unix_micros(F.lead("ts").over(order)) - F.unix_micros("ts")) / 1e6).alias("weight"))
    return Graph.of(rows.filter(F.col("dst").isNotNull() & (F.col("weight") < gap_seconds)))
