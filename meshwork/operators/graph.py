"""A graph as a DataFrame of edges: (src, dst) or (src, dst, weight).

Multigraphs: repeated edges and self-loops are kept everywhere.  Vertices are 0 to the largest id seen, gaps included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.sources.text import checked


@dataclass(frozen=True)
class Graph:
    edges: DataFrame

    @staticmethod
    def of(edges: DataFrame) -> Graph:
        """From any edges with columns src, dst and perhaps weight; ids are checked as rows are read."""
        columns = [F.col("src").cast("long"), F.col("dst").cast("long")]
        if "weight" in edges.columns:
            columns.append(F.col("weight").cast("double"))
        return Graph(checked(edges.select(*columns)))

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    def unweighted(self) -> Graph:
        return Graph(self.edges.select("src", "dst"))

    def directed(self, direction: str = "directed") -> Graph:
        """``directed``, ``undirected`` (every edge both ways) or ``transposed``."""
        kinds = {"directed": lambda: self, "undirected": self.symmetrize, "transposed": self.transpose}
        if direction not in kinds:
            raise ValueError(f"direction must be one of {', '.join(kinds)}")
        return kinds[direction]()

    def transpose(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    def symmetrize(self) -> Graph:
        """Forward and reverse edges; each reverse edge carries its own weight, and a self-loop doubles."""
        return Graph(self.edges.unionAll(self.transpose().edges))

    def deduplicated(self) -> Graph:
        """Without repeated (src, dst); the smallest weight stays."""
        if self.weighted:
            return Graph(self.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
        return Graph(self.edges.distinct())

    def num_vertices_frame(self) -> DataFrame:
        return self.edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("num_vertices"))

    def num_vertices(self) -> int:
        return self.num_vertices_frame().head()[0] or 0

    def vertices(self) -> DataFrame:
        return self.edges.sparkSession.range(self.num_vertices())

    def out_degrees(self) -> DataFrame:
        """(id, degree) of vertices with out-edges."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))

    def total_degrees(self) -> DataFrame:
        """In and out; a self-loop counts twice."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return ends.groupBy("id").agg(F.count("*").alias("degree"))

    def degrees(self, direction: str = "total") -> DataFrame:
        return {"out": self.out_degrees, "in": self.in_degrees}.get(direction, self.total_degrees)()

    def degree_distribution(self, direction: str = "total", bins: int | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
        """(degree, vertices), or with ``bins`` equal widths from the least to the greatest degree: (bin, low, high, vertices).

        ``least`` and ``most`` bound the degrees that count, and are the ends of the bins where they are given.
        """
        degrees = self.degrees(direction)
        if least is not None:
            degrees = degrees.filter(F.col("degree") >= least)
        if most is not None:
            degrees = degrees.filter(F.col("degree") <= most)
        if bins is None:
            return degrees.groupBy("degree").agg(F.count("*").alias("vertices"))
        ends = degrees.agg(F.min("degree"), F.max("degree")).head()
        if ends[0] is None:
            return degrees.select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("vertices")).limit(0)
        ends = [ends[0] if least is None else least, ends[1] if most is None else most]
        width = max(ends[1] - ends[0], 1) / bins
        at = F.least(F.floor((F.col("degree") - ends[0]) / width).cast("int"), F.lit(bins - 1))
        counts = degrees.groupBy(at.alias("bin")).agg(F.count("*").alias("vertices"))
        return counts.select("bin", (ends[0] + F.col("bin") * width).alias("low"), (ends[0] + (F.col("bin") + 1) * width).alias("high"), "vertices")

    def adjacency(self) -> DataFrame:
        """(src, degree, nbrs): neighbours in order, as ids or as structs with weights."""
        item: Column = F.struct("dst", "weight") if self.weighted else F.col("dst")
        return self.edges.groupBy("src").agg(F.count("*").alias("degree"), F.array_sort(F.collect_list(item)).alias("nbrs"))


def top_k(vector: DataFrame, k: int, value: str = "value") -> DataFrame:
    """The k largest values, ties by id."""
    return vector.orderBy(F.desc(value), "id").limit(k)
