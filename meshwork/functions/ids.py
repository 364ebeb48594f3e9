"""Block and local ids: a global id is ``local * p + block``, so vertices are dealt round robin to p blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_id(vertex: Column, p: int) -> Column:
    return F.pmod(vertex, F.lit(p)).cast("int")


def local_id(vertex: Column, p: int) -> Column:
    """Integer division: division of longs by ``/`` would go through doubles."""
    return F.call_function("div", vertex, F.lit(p)).cast("long")


def global_id(local: Column, block: Column, p: int) -> Column:
    return local.cast("long") * p + block


def is_dense(degree: Column, threshold: int) -> Column:
    """Below zero nothing is dense, at zero everything is."""
    return F.lit(threshold >= 0) & (degree >= threshold)
