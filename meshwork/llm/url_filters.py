"""URL filters: the longest rule that covers a url, by a sort-merge range join.

A rule is ``host/path``: it covers its host and all subdomains, where the url's path starts with the rule's.  A host turned
round, label by label with a dot after each, makes the hosts below a rule's host one interval of keys, from ``com.example.``
up to ``com.example/`` (``/`` follows ``.``); such intervals are nested or apart.  Rules' intervals and urls are dealt by
range of key and sorted; a sweep keeps the stack of rules whose intervals are open, one event at a time: what is open after
an event is the same for all urls up to the next, so each event carries its stack and a running ``last`` hands it on.
What is open where a part begins comes from the last event of the parts before it.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpoint, lower_ascii, partitions

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_STACK = "array<struct<size:int,blocks:int,rule:string,path:string,verdict:string>>"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """A table (rule, verdict) of literals."""
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules]
    none = spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("verdict"))
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else none


def _events(rules: DataFrame) -> DataFrame:
    """Where intervals open and close: (key, kind, stack); the stack has the longest rule first, and block before allow."""
    r = rules.filter(F.col("rule").isNotNull()).select("rule", "verdict", F.regexp_extract("rule", "(?s)^([^/]*)(.*)$", 1).alias("h"), F.regexp_extract("rule", "(?s)^([^/]*)(.*)$", 2).alias("p")).distinct()
    r = r.filter(F.col("h") != "")  # a rule without a host covers nothing
    item = F.struct((-F.length("rule")).cast("int").alias("size"), (F.col("verdict") != "block").cast("int").alias("blocks"), F.col("rule"), F.col("p").alias("path"), F.col("verdict"))
    nodes = r.groupBy(host_key(lower_ascii(F.col("h"))).alias("key")).agg(F.collect_set(item).alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    above = nodes.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))).alias("up"))
    chain = above.join(nodes.select(F.col("key").alias("up"), "own"), "up").groupBy("key").agg(
        F.array_sort(F.flatten(F.collect_list("own"))).alias("inside"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("own"))))).alias("outside"),
    )
    closes = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    opened = chain.select("key", F.lit(1).alias("kind"), F.col("inside").cast(_STACK).alias("stack"))
    return opened.unionAll(chain.select(closes.alias("key"), F.lit(0).alias("kind"), F.coalesce("outside", F.array()).cast(_STACK).alias("stack")))


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", keys: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """keys, host, path, rule (null if none fits) and verdict (the rule's, else ``default``) of each row of pages.

    Null urls and urls without :// have an empty host and path, which no rule covers.  Of rules that are alike but for the
    verdict, block wins.  Repeated rows are judged alike; no rules or no pages are fine; other columns do not matter.
    The stack of a host lists all rules of the host and its parents, so its size follows the rules per host.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    u = F.col(url).cast("string")
    row = F.struct(*(F.col(c) for c in keys), host_of(u).alias("__host"), path_of(u).alias("__path")).alias("row")
    points = pages.select(row).select(host_key(F.col("row.__host")).alias("key"), F.lit(2).alias("kind"), F.xxhash64("row").alias("tie"), "row", F.lit(None).cast(_STACK).alias("stack"))
    events = _events(rules).select("key", "kind", F.lit(0).cast("long").alias("tie"), F.lit(None).cast(points.schema["row"].dataType).alias("row"), "stack")
    # the tie splits a hot host; the checkpoint keeps the dealing fixed
    dealt = checkpoint(points.unionAll(events).repartitionByRange(n, "key", "kind", "tie").withColumn("part", F.spark_partition_id()))
    last = dealt.filter("kind < 2").groupBy("part").agg(F.max_by("stack", F.struct("key", "kind")).alias("last"))
    parts = dealt.select("part").distinct()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as parts
    opens = parts.join(last, "part", "left").select("part", F.last("last", ignorenulls=True).over(before).alias("opens"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.select("part", "kind", "row", F.last("stack", ignorenulls=True).over(sweep).alias("stack")).filter("kind = 2")
    stack = F.coalesce("stack", "opens", F.array().cast(_STACK))
    best = F.get(F.filter(stack, lambda r: F.col("row.__path").startswith(r["path"])), F.lit(0))
    judged = swept.join(F.broadcast(opens), "part").select("row", best.alias("best"))
    return judged.select(*(F.col("row")[c].alias(c) for c in keys), F.col("row.__host").alias("host"), F.col("row.__path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
