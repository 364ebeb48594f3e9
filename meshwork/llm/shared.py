"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.session import Scratch, delete_folder, shared_folder

__all__ = ["Packed", "Scratch", "checkpoint", "delete_folder", "lower_ascii", "partitions", "ranked", "shared_folder", "small_batches"]


class Packed:
    """docs as __text and a struct __row of the other columns, so that a text goes to a Python worker and back only once.

    A text column of another type than string stays in the struct, too, and is given back from there where the text has not changed.
    """

    def __init__(self, docs: DataFrame, text: str):
        self.docs, self.text = docs, text
        self.kind = docs.schema[text].dataType
        self.fields = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text or self.kind.simpleString() != "string"}
        row = F.struct(F.lit(1).alias("__"), *(F.col(c).alias(f) for c, f in self.fields.items()))
        self.rows = docs.select(row.alias("__row"), F.col(text).cast("string").alias("__text"))
        self.row_kind = self.rows.schema["__row"].dataType.simpleString()

    def unpack(self, rows: DataFrame, changed: Column | None = None) -> DataFrame:
        """The columns of docs; changed: the text that stands in place of __text, null where it stays as it is."""
        body = F.col("__row")[self.fields[self.text]] if self.text in self.fields else F.col("__text")
        if changed is not None:
            body = F.when(changed.isNotNull(), changed.cast(self.kind)).otherwise(body)
        return rows.select(*(body.alias(c) if c == self.text else F.col("__row")[self.fields[c]].alias(c) for c in self.docs.columns))


def small_batches(spark: SparkSession) -> None:
    """Lets texts go to Python workers in Arrow batches of 4 MB, unless the session asks for less: a batch is held by the executor's
    Arrow buffers and by the worker, and the kernels work in slices of 0.5 MB anyway."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).removesuffix("b")
    if not held.isdigit() or not 0 < int(held) <= 4 << 20:
        spark.conf.set(key, str(4 << 20))


def checkpoint(df: DataFrame) -> DataFrame:
    """A copy in the shared folder, with its lineage cut, which survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Adds each row's place (from 0) in the order of the given columns, as a distributed sort.

    Rows are dealt by range, sorted and numbered within each part, and shifted by the sizes of the parts before: one shuffle, and no task
    sees more than one part.  The parts are checkpointed with their numbers, so a lost executor cannot deal them in another way.  Rows that
    are alike in all columns of the order get places next to each other.
    """
    n = partitions(df.sparkSession)
    part, number = f"__{name}_part", f"__{name}_number"
    # a row's number has its part above 33 bits, and its place in the part below
    dealt = checkpoint(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(part, F.shiftright(number, 33).cast("int"))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("__n"))
    before = sizes.select(part, F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # `before` has one row a part: at most as many as spark.sql.shuffle.partitions says
    place = F.col(number).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")
    return dealt.join(F.broadcast(before), part).withColumn(name, place.cast("long")).drop(part, number, "__before")
