"""The registered graph queries and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.counters import count_all, counter
from meshwork.functions.ids import block_id, global_id, local_id
from meshwork.operators import blocks
from meshwork.operators.graph import Graph, top_k
from meshwork.plans import gimv, programs
from meshwork.session import shared_folder
from meshwork.sources import text
from meshwork.sources.derived import event_sessions, part_hi, part_sequence, trade

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_SEQ = """seq AS (
    SELECT l_partkey AS src, lead(l_partkey) OVER w AS dst, l_quantity AS weight FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
part_seq AS MATERIALIZED (SELECT * FROM seq WHERE dst IS NOT NULL),
part_hi AS MATERIALIZED (SELECT * FROM part_seq WHERE weight >= 46),
trade AS MATERIALIZED (SELECT l_suppkey AS src, l_partkey + (SELECT max(s_suppkey) + 1 FROM supplier) AS dst, l_quantity AS weight FROM lineitem),
next_event AS (
    SELECT event_id AS src, lead(event_id) OVER w AS dst, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0 AS weight FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
event_sess AS MATERIALIZED (SELECT * FROM next_event WHERE dst IS NOT NULL AND weight < 7200)"""
_GRAPHS = {"part_seq": part_sequence, "part_hi": part_hi, "trade": trade, "event_sess": event_sessions}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query under the function's name; sql follows the graphs' definitions."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{_SEQ}{'' if sql.lstrip().startswith('SELECT') else ','} {sql}"
        return f

    return register


def _rounded(vector: DataFrame, name: str = "value", digits: int = 9) -> DataFrame:
    return vector.select("id", F.round("value", digits).alias(name))


# --- SQL of blocks and paths


def _columns_sql(graph: str, p: int, threshold: int) -> str:
    return f"""deg AS (SELECT src, count(*) AS degree FROM {graph} GROUP BY 1),
        cols AS (SELECT CASE WHEN {threshold} >= 0 AND degree >= {threshold} THEN 'dense' ELSE 'sparse' END AS region, CAST(dst % {p} AS INTEGER) AS row_block, CAST(e.src % {p} AS INTEGER) AS col_block,
            e.src // {p} AS col, degree, dst // {p} AS r, weight FROM {graph} e JOIN deg USING (src))"""


def _matrix_sql(graph: str, p: int, threshold: int, where: str = "") -> str:
    return _columns_sql(graph, p, threshold) + " SELECT region, row_block, col_block, col, degree, string_agg(CAST(r AS VARCHAR), ' ' ORDER BY r) AS entries FROM cols" + where + " GROUP BY ALL"


def _stats_sql(graph: str, p: int, threshold: int) -> str:
    return _columns_sql(graph, p, threshold) + " SELECT region, row_block, col_block, count(*) AS num_rows, count(DISTINCT col) AS num_cols FROM cols GROUP BY ALL"


def _path_sql(source: int, rounds: int | None = None, weight: str = "weight", graph: str = "part_hi") -> str:
    stop = f"it < {rounds}" if rounds is not None else "(SELECT bool_or(moved) FROM sp)"
    return f"""g AS MATERIALIZED (SELECT src, dst, {weight} AS weight FROM {graph}), size AS (SELECT greatest(max(src), max(dst)) + 1 AS n FROM g),
        sp(it, id, d, moved) AS (
            SELECT 0, id, CASE WHEN id = {source} THEN 0.0::DOUBLE END, true FROM (SELECT unnest(range(n)) AS id FROM size)
            UNION ALL
            SELECT it + 1, id, least(d, c), c IS NOT NULL AND (d IS NULL OR c < d) FROM (
                SELECT p.it, p.id, p.d, m.c FROM sp p LEFT JOIN (SELECT g.dst, min(q.d + g.weight) AS c FROM sp q JOIN g ON g.src = q.id GROUP BY 1) m ON m.dst = p.id)
            WHERE {stop})
        SELECT id, d AS distance FROM sp WHERE it = (SELECT max(it) FROM sp)"""


# --- sources and transforms


@query("SELECT src, dst FROM part_seq")
def edges_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return part_sequence(spark, d).unweighted().edges


@query("SELECT src, dst, weight FROM part_hi")
def edges_weighted(spark: SparkSession, d: str) -> DataFrame:
    return part_hi(spark, d).edges


@query("SELECT greatest(max(src), max(dst)) + 1 AS num_vertices FROM part_hi")
def num_vertices(spark: SparkSession, d: str) -> DataFrame:
    return part_hi(spark, d).num_vertices_frame()


@query("SELECT id FROM (SELECT unnest(range(greatest(max(src), max(dst)) + 1)) AS id FROM part_hi)")
def vertices(spark: SparkSession, d: str) -> DataFrame:
    return part_hi(spark, d).vertices()


@query("SELECT dst AS src, src AS dst FROM part_hi")
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return part_hi(spark, d).unweighted().transpose().edges


@query("SELECT src, dst FROM part_hi UNION ALL SELECT dst, src FROM part_hi")
def symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return part_hi(spark, d).unweighted().symmetrize().edges


@query("SELECT src, dst, weight FROM part_seq UNION ALL SELECT dst, src, weight FROM part_seq")
def symmetrize_part_seq(spark: SparkSession, d: str) -> DataFrame:
    return part_sequence(spark, d).symmetrize().edges


@query("SELECT src, dst, weight FROM part_hi UNION ALL SELECT dst, src, weight FROM part_hi")
def symmetrize_weighted(spark: SparkSession, d: str) -> DataFrame:
    return part_hi(spark, d).symmetrize().edges


@query("SELECT src, dst, min(weight) AS weight FROM part_seq GROUP BY ALL")
def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return part_sequence(spark, d).deduplicated().edges


@query("SELECT src, dst, src // 7 AS src_local, CAST(src % 7 AS INTEGER) AS src_block, dst // 7 AS dst_local, CAST(dst % 7 AS INTEGER) AS dst_block, src AS src_again FROM part_hi")
def local_ids(spark: SparkSession, d: str) -> DataFrame:
    e = part_hi(spark, d).unweighted().edges
    src, dst = F.col("src"), F.col("dst")
    again = global_id(local_id(src, 7), block_id(src, 7), 7)
    return e.select("src", "dst", local_id(src, 7).alias("src_local"), block_id(src, 7).alias("src_block"), local_id(dst, 7).alias("dst_local"), block_id(dst, 7).alias("dst_block"), again.alias("src_again"))


# --- text and block files: written to the shared folder and read again


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


@query("SELECT src, dst FROM part_seq")
def text_edge_list(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    text.write_edge_list(part_sequence(spark, d).unweighted().edges, path)
    return text.read_edge_list(spark, path)


@query("SELECT src, dst, weight FROM part_seq")
def text_edge_list_weighted(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    text.write_edge_list(part_sequence(spark, d).edges, path, ",")
    return text.read_edge_list(spark, path, weighted=True, delimiter=",")


@query("SELECT src, dst FROM part_seq")
def text_adjacency_list(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    text.write_adjacency_list(part_sequence(spark, d).unweighted().edges, path)
    return text.read_adjacency_list(spark, path)


@query("SELECT src, dst, weight FROM part_seq")
def text_adjacency_list_weighted(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    text.write_adjacency_list(part_sequence(spark, d).edges, path, ";", ",")
    return text.read_adjacency_list(spark, path, weighted=True, vertex_delimiter=";", edge_delimiter=",")


@query("SELECT src, dst FROM trade UNION ALL SELECT src, dst FROM part_seq")
def text_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders within folders are one graph."""
    path = _path(spark)
    text.write_edge_list(trade(spark, d).unweighted().edges, f"{path}/a/b")
    text.write_edge_list(part_sequence(spark, d).unweighted().edges, f"{path}/c")
    return text.read_edge_list(spark, path)


@query("SELECT dst AS id, count(*) AS value FROM trade GROUP BY 1")
def text_degrees(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    text.write_vector(trade(spark, d).in_degrees(), path)
    return text.read_vector(spark, path, "long")


@query(_path_sql(0, rounds=2), recursive=True)
def text_vector(spark: SparkSession, d: str) -> DataFrame:
    """Distances as a file; no value stands for unreachable."""
    path = _path(spark)
    text.write_vector(programs.shortest_paths(part_hi(spark, d), 0, 2).vector, path)
    return text.read_vector(spark, path).withColumnRenamed("value", "distance")


@query("SELECT src, dst, weight FROM part_seq")
def block_files(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    blocks.write_blocks(part_sequence(spark, d), path, 4, 20)
    return blocks.read_blocks(spark, path).edges


@query(_matrix_sql("trade", 3, 600, " WHERE region = 'dense' AND row_block = 1"))
def block_files_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Only the folders of some blocks are read."""
    path = _path(spark)
    blocks.write_blocks(trade(spark, d).unweighted(), path, 3, 600)
    found = blocks.read_columns(spark, path, region="dense", row_block=1)
    return found.select(*blocks.KEYS, "col", "degree", F.array_join("rows", " ").alias("entries"))


@query(_stats_sql("part_seq", 4, 20))
def block_file_stats(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    blocks.write_blocks(part_sequence(spark, d), path, 4, 20)
    return blocks.read_stats(spark, path).select(*blocks.KEYS, "num_rows", "num_cols")


@query("SELECT CAST(greatest(max(src), max(dst)) + 1 AS BIGINT) AS num_vertices, 3 AS p, 600 AS threshold, true AS weighted FROM trade")
def block_file_meta(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    blocks.write_blocks(trade(spark, d), path, 3, 600)
    return blocks.read_meta(spark, path)


# --- degrees and counters


@query("SELECT src AS id, count(*) AS degree FROM part_seq GROUP BY 1")
def out_degree(spark: SparkSession, d: str) -> DataFrame:
    return part_sequence(spark, d).out_degrees()


@query("SELECT dst AS id, count(*) AS degree FROM part_seq GROUP BY 1")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return part_sequence(spark, d).in_degrees()


@query("SELECT id, count(*) AS degree FROM (SELECT src AS id FROM part_seq UNION ALL SELECT dst FROM part_seq) GROUP BY 1")
def total_degree(spark: SparkSession, d: str) -> DataFrame:
    return part_sequence(spark, d).total_degrees()


@query("SELECT degree, count(*) AS vertices FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM trade UNION ALL SELECT dst FROM trade) GROUP BY 1) GROUP BY 1")
def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).degree_distribution()


@query("""deg AS (SELECT src, count(*) AS degree FROM trade GROUP BY 1), ends AS (SELECT min(degree) AS a, greatest(max(degree) - min(degree), 1) / 50.0 AS w FROM deg)
    SELECT CAST(bin AS INTEGER) AS bin, count(*) AS vertices FROM (SELECT least(floor((degree - a) / w), 49) AS bin FROM deg, ends) GROUP BY 1""")
def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).degree_distribution("out", 50).select("bin", "vertices")


@query("""deg AS (SELECT src, count(*) AS degree FROM trade GROUP BY 1)
    SELECT CAST(bin AS INTEGER) AS bin, count(*) AS vertices FROM (SELECT least(floor((degree - 550) / 5.0), 19) AS bin FROM deg WHERE degree BETWEEN 550 AND 650) GROUP BY 1""")
def degree_histogram_bounded(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).degree_distribution("out", 20, 550, 650).select("bin", "vertices")


@query("SELECT src, count(*) AS degree, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS nbrs FROM part_hi GROUP BY 1")
def adjacency_list(spark: SparkSession, d: str) -> DataFrame:
    return part_hi(spark, d).unweighted().adjacency().select("src", "degree", F.array_join("nbrs", " ").alias("nbrs"))


@query("SELECT src, count(*) AS degree, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS nbrs FROM trade GROUP BY 1")
def adjacency_list_trade(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).unweighted().adjacency().select("src", "degree", F.array_join("nbrs", " ").alias("nbrs"))


@query("SELECT src, count(*) AS degree, string_agg(CAST(dst AS VARCHAR) || ':' || CAST(CAST(weight AS INTEGER) AS VARCHAR), ' ' ORDER BY dst, weight) AS nbrs FROM part_hi GROUP BY 1")
def adjacency_list_weighted(spark: SparkSession, d: str) -> DataFrame:
    item = F.transform("nbrs", lambda x: F.concat(x["dst"].cast("string"), F.lit(":"), x["weight"].cast("int").cast("string")))
    return part_hi(spark, d).adjacency().select("src", "degree", F.array_join(item, " ").alias("nbrs"))


@query("SELECT min(weight) AS least, max(weight) AS most, CAST(sum(dst) AS BIGINT) AS total, min(src) AS first, bool_and(weight > 46) AS every, bool_or(weight > 46) AS some FROM part_hi")
def global_counters(spark: SparkSession, d: str) -> DataFrame:
    e = part_hi(spark, d).edges.withColumn("big", F.col("weight") > 46)
    return e.agg(counter("weight", "min").alias("least"), counter("weight", "max").alias("most"), counter("dst", "sum").alias("total"), counter("src", "min").alias("first"), counter("big", "min", True).alias("every"), counter("big", "sum", True).alias("some"))


# --- blocks


def _matrix(graph: Graph, p: int, threshold: int) -> DataFrame:
    found = blocks.matrix_columns(graph.unweighted(), p, threshold)
    return found.select(*blocks.KEYS, "col", "degree", F.array_join("rows", " ").alias("entries"))


@query(_matrix_sql("part_hi", 4, 4))
def matrix_columns(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(part_hi(spark, d), 4, 4)


@query(_matrix_sql("trade", 3, 100))
def matrix_columns_trade(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(trade(spark, d), 3, 100)


@query(_stats_sql("part_hi", 4, 4))
def block_stats(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_stats(blocks.matrix_columns(part_hi(spark, d), 4, 4))


@query(_stats_sql("trade", 3, 100))
def block_stats_trade(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_stats(blocks.matrix_columns(trade(spark, d), 3, 100))


@query("SELECT src AS id, count(*) AS degree FROM trade GROUP BY 1 HAVING count(*) >= 600")
def dense_vertices(spark: SparkSession, d: str) -> DataFrame:
    return blocks.dense_vertices(trade(spark, d), 600)


@query("SELECT src, dst, weight FROM part_hi")
def edges_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.edges_of(blocks.matrix_columns(part_hi(spark, d), 5, 3), 5)


# --- programs


def _rank_sql(graph: str = "part_hi", rounds: int | None = None, alpha: float = 0.85, source: int | None = None, tail: str = "SELECT id, round(r / (SELECT sum(r) FROM last), 9) AS score FROM last") -> str:
    at = "1.0::DOUBLE / n" if source is None else f"CASE WHEN id = {source} THEN 1.0::DOUBLE ELSE 0 END"
    teleport = "1.0 / n" if source is None else f"CASE WHEN p.id = {source} THEN 1.0 ELSE 0 END"
    stop = f"it < {rounds}" if rounds is not None else "(SELECT bool_or(moved) FROM pr)"
    return f"""g AS MATERIALIZED (SELECT src, dst FROM {graph}), size AS MATERIALIZED (SELECT greatest(max(src), max(dst)) + 1 AS n FROM g),
        deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM g GROUP BY 1),
        pr(it, id, r, moved) AS (
            SELECT 0, id, {at}, true FROM (SELECT n, unnest(range(n)) AS id FROM size)
            UNION ALL
            SELECT it + 1, id, CASE WHEN abs(c - r) > 1e-8 THEN c ELSE r END, abs(c - r) > 1e-8 FROM (
                SELECT p.it, p.id, p.r, {alpha} * coalesce(m.s, 0) + (1 - {alpha}) * ({teleport}) AS c
                FROM pr p CROSS JOIN size LEFT JOIN (SELECT g.dst, sum(q.r / deg.degree) AS s FROM pr q JOIN deg ON deg.src = q.id JOIN g ON g.src = q.id GROUP BY 1) m ON m.dst = p.id)
            WHERE {stop}),
        last AS (SELECT id, r FROM pr WHERE it = (SELECT max(it) FROM pr))
        {tail}"""


def _label_sql(graph: str, both: bool = False, turn: bool = False, rounds: int | None = None, largest: bool = False, tail: str = "SELECT id, l AS label FROM last") -> str:
    stop = f"it < {rounds}" if rounds is not None else "(SELECT bool_or(moved) FROM lp)"
    edges = f"SELECT dst AS src, src AS dst FROM {graph}" if turn else f"SELECT src, dst FROM {graph}" + (f" UNION ALL SELECT dst, src FROM {graph}" if both else "")
    pick, agg, sign = ("greatest", "max", ">") if largest else ("least", "min", "<")
    return f"""g AS MATERIALIZED ({edges}), size AS (SELECT greatest(max(src), max(dst)) + 1 AS n FROM g),
        lp(it, id, l, moved) AS (
            SELECT 0, id, id, true FROM (SELECT unnest(range(n)) AS id FROM size)
            UNION ALL
            SELECT it + 1, id, {pick}(l, coalesce(c, l)), coalesce(c {sign} l, false) FROM (
                SELECT p.it, p.id, p.l, m.c FROM lp p LEFT JOIN (SELECT g.dst, {agg}(q.l) AS c FROM lp q JOIN g ON g.src = q.id GROUP BY 1) m ON m.dst = p.id)
            WHERE {stop}),
        last AS (SELECT id, l FROM lp WHERE it = (SELECT max(it) FROM lp))
        {tail}"""


def _rank(name: str, graph: str, sql: str, call) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(call(_GRAPHS[graph](spark, d)).vector, "score")

    f.__name__ = name
    query(sql, recursive=True)(f)


_rank("pagerank_k1", "part_hi", _rank_sql(rounds=1), lambda g: programs.pagerank(g, 1))
_rank("pagerank_k10", "part_hi", _rank_sql(rounds=10), lambda g: programs.pagerank(g, 10))
_rank("pagerank_converged", "part_hi", _rank_sql(), lambda g: programs.pagerank(g))
_rank("pagerank_alpha50", "part_hi", _rank_sql(alpha=0.5), lambda g: programs.pagerank(g, damping=0.5))
_rank("pagerank_trade", "trade", _rank_sql("trade"), lambda g: programs.pagerank(g))
_rank("pagerank_part_seq", "part_seq", _rank_sql("part_seq", rounds=5), lambda g: programs.pagerank(g, 5))
_rank("rwr_part_seq", "part_seq", _rank_sql("part_seq", rounds=5, source=0), lambda g: programs.random_walk(g, 0, 5))
_rank("rwr_source0", "part_hi", _rank_sql(source=0), lambda g: programs.random_walk(g, 0))
_rank("rwr_source7", "part_hi", _rank_sql(source=7, rounds=10), lambda g: programs.random_walk(g, 7, 10))
for _t in (-1, 0, 4, 100):
    _name = f"hybrid_pagerank_{'none' if _t < 0 else _t}"
    _rank(_name, "part_hi", _rank_sql(rounds=4), lambda g, t=_t: programs.pagerank(g, 4, dense_threshold=t))
_rank("hybrid_pagerank_trade", "trade", _rank_sql("trade", rounds=3), lambda g: programs.pagerank(g, 3, dense_threshold=600))


@query(_rank_sql(rounds=10, tail="SELECT id, score FROM (SELECT id, round(r / (SELECT sum(r) FROM last), 9) AS score FROM last) ORDER BY score DESC, id LIMIT 20"), recursive=True)
def pagerank_top20(spark: SparkSession, d: str) -> DataFrame:
    return top_k(_rounded(programs.pagerank(part_hi(spark, d), 10).vector, "score"), 20, "score")


def _paths(name: str, sql: str, call, graph: str = "part_hi") -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return call(_GRAPHS[graph](spark, d)).vector.select("id", F.col("value").alias("distance"))

    f.__name__ = name
    query(sql, recursive=True)(f)


_paths("sssp_source0", _path_sql(0), lambda g: programs.shortest_paths(g, 0))
_paths("sssp_source7", _path_sql(7), lambda g: programs.shortest_paths(g, 7))
_paths("sssp_k3", _path_sql(0, rounds=3), lambda g: programs.shortest_paths(g, 0, 3))
_paths("sssp_bfs_hops", _path_sql(0, weight="1.0::DOUBLE"), lambda g: programs.hops(g, 0))
_paths("sssp_part_seq", _path_sql(0, graph="part_seq"), lambda g: programs.shortest_paths(g, 0), "part_seq")
_paths("sssp_hybrid", _path_sql(0, rounds=4), lambda g: programs.shortest_paths(g, 0, 4, dense_threshold=4))


def _labels(name: str, graph: str, sql: str, call) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return call(_GRAPHS[graph](spark, d)).vector.select("id", F.col("value").alias("label"))

    f.__name__ = name
    query(sql, recursive=True)(f)


_labels("wcc", "part_hi", _label_sql("part_hi", both=True), lambda g: programs.connected_components(g))
_labels("wcc_event_sess", "event_sess", _label_sql("event_sess", both=True), lambda g: programs.connected_components(g))
_labels("wcc_part_seq", "part_seq", _label_sql("part_seq", both=True), lambda g: programs.connected_components(g))
_labels("wcc_trade", "trade", _label_sql("trade", both=True), lambda g: programs.connected_components(g))
_labels("min_label_part_seq", "part_seq", _label_sql("part_seq"), lambda g: programs.min_label(g))
_labels("wcc_k2", "part_hi", _label_sql("part_hi", both=True, rounds=2), lambda g: programs.connected_components(g, 2))
_labels("min_label_directed", "part_hi", _label_sql("part_hi"), lambda g: programs.min_label(g))
_labels("min_label_transposed", "part_hi", _label_sql("part_hi", turn=True), lambda g: programs.min_label(g, "transposed"))
_labels("custom_program_maxlabel", "part_hi", _label_sql("part_hi", largest=True), lambda g: programs.max_label(g))


@query(_label_sql("part_hi", both=True, tail="SELECT label, count(*) AS vertices FROM (SELECT id, l AS label FROM last) GROUP BY 1"), recursive=True)
def wcc_sizes(spark: SparkSession, d: str) -> DataFrame:
    return programs.connected_components(part_hi(spark, d)).vector.groupBy(F.col("value").alias("label")).agg(F.count("*").alias("vertices"))


def _contracted(name: str, graph: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return programs.contracted_components(_GRAPHS[graph](spark, d)).withColumnRenamed("value", "label")

    f.__name__ = name
    query(_label_sql(graph, both=True), recursive=True)(f)


_contracted("wcc_contracted", "event_sess")
_contracted("wcc_contracted_part_seq", "part_seq")


@query()
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Estimated pairs within so many hops, and the effective diameter; estimates, so without SQL: tests hold them against a search."""
    pairs = programs.neighbourhood(part_hi(spark, d))
    rows = [(i, n, programs.effective_diameter(pairs)) for i, n in enumerate(pairs)]
    return spark.createDataFrame(rows, "hops int, pairs double, effective_diameter double")


# --- parts of a round


def _round(spark: SparkSession, d: str, program: gimv.Program, graph: Graph | None = None, threshold: int = -1) -> DataFrame:
    """One round on its own: the initial vector and the vector after it."""
    g = graph or part_hi(spark, d)
    layout = gimv.Layout(g, program, threshold, gimv.MAX_BROADCAST)
    ctx = gimv.Context(layout.n)
    return gimv.superstep(layout, gimv.initial(layout, program, ctx), program, ctx, 1)


def _probe(combine2, merge, kind: str, weighted: bool = False) -> gimv.Program:
    """A program whose vector after a round is the merged message itself."""
    return gimv.Program(init=lambda ctx, i: i, combine2=combine2, combine_all=merge, apply=lambda ctx, i, old, m: m, changed=lambda ctx, a, b: F.lit(True), kind=kind, weighted=weighted)


@query("""deg AS (SELECT src, count(*) AS degree FROM part_hi GROUP BY 1), m AS (SELECT dst AS id, sum(CAST(src AS DOUBLE) / degree) AS s FROM part_hi JOIN deg USING (src) GROUP BY 1),
    size AS (SELECT unnest(range(greatest(max(src), max(dst)) + 1)) AS id FROM part_hi) SELECT id, round(s, 6) AS message FROM size LEFT JOIN m USING (id)""")
def combine2_sum(spark: SparkSession, d: str) -> DataFrame:
    found = _round(spark, d, _probe(lambda ctx, v, degree, w: v / degree, F.sum, "double"))
    return found.select("id", F.round("value", 6).alias("message"))


@query("""m AS (SELECT dst AS id, min(src) AS s FROM part_hi GROUP BY 1), size AS (SELECT unnest(range(greatest(max(src), max(dst)) + 1)) AS id FROM part_hi)
    SELECT id, s AS message FROM size LEFT JOIN m USING (id)""")
def combine2_min(spark: SparkSession, d: str) -> DataFrame:
    return _round(spark, d, _probe(lambda ctx, v, degree, w: v, F.min, "long")).select("id", F.col("value").alias("message"))


@query("""m AS (SELECT dst AS id, min(src + weight) AS s FROM part_hi GROUP BY 1), size AS (SELECT unnest(range(greatest(max(src), max(dst)) + 1)) AS id FROM part_hi)
    SELECT id, s AS message FROM size LEFT JOIN m USING (id)""")
def combine2_minplus(spark: SparkSession, d: str) -> DataFrame:
    return _round(spark, d, _probe(lambda ctx, v, degree, w: v + w, F.min, "double", weighted=True)).select("id", F.col("value").alias("message"))


@query("""m AS (SELECT dst AS id, min(src) AS s FROM part_hi GROUP BY 1), size AS (SELECT unnest(range(greatest(max(src), max(dst)) + 1)) AS id FROM part_hi)
    SELECT id, least(id, coalesce(s, id)) AS value, CAST(coalesce(s < id, false) AS INTEGER) AS changed_at FROM size LEFT JOIN m USING (id)""")
def apply_left_join(spark: SparkSession, d: str) -> DataFrame:
    return _round(spark, d, programs.label_program()).select("id", "value", "changed_at")


@query("SELECT id, round(degree / (SELECT sum(degree) FROM (SELECT src, count(*) AS degree FROM part_hi GROUP BY 1)), 9) AS value FROM (SELECT src AS id, count(*) AS degree FROM part_hi GROUP BY 1)")
def normalize_l1(spark: SparkSession, d: str) -> DataFrame:
    degrees = part_hi(spark, d).out_degrees().select("id", F.col("degree").cast("double").alias("value"))
    return _rounded(programs.normalised(degrees))


@query(_label_sql("part_hi", both=True, tail="SELECT CAST(max(it) AS INTEGER) AS iterations, true AS converged, (SELECT count(DISTINCT l) FROM last) AS components FROM lp"), recursive=True)
def converged_flag(spark: SparkSession, d: str) -> DataFrame:
    result = programs.connected_components(part_hi(spark, d))
    parts = count_all(result.vector.select("value").distinct(), n=F.count("*"))["n"]
    return spark.range(1).select(F.lit(result.iterations).alias("iterations"), F.lit(result.converged).alias("converged"), F.lit(parts).cast("long").alias("components"))
