"""Global counters over a column: one aggregation, NULL on an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"min": F.min, "max": F.max, "sum": F.sum}
#: Sum of booleans is OR, and their minimum AND, as 1 stands for true.
BOOLEAN = {"min": F.bool_and, "max": F.bool_or, "sum": F.bool_or}


def counter(column: str, kind: str, boolean: bool = False) -> Column:
    return (BOOLEAN if boolean else KINDS)[kind](column)


def count_all(df: DataFrame, **wanted: Column) -> dict:
    """Several counters in one pass: name=counter(...)."""
    return df.agg(*(c.alias(name) for name, c in wanted.items())).head().asDict()
