import pytest
from pyspark.sql import functions as F

from meshwork import cli
from meshwork.functions.counters import count_all, counter
from meshwork.functions.ids import block_id, global_id, local_id
from meshwork.operators import blocks
from meshwork.operators.graph import Graph
from meshwork.sources import text

from .test_programs import EDGES, GOLDEN


@pytest.fixture(scope="module")
def t1(spark):
    return Graph.of(spark.createDataFrame(EDGES, "src long, dst long, weight double"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def test_degrees(t1):
    assert rows(t1.out_degrees()) == [(0, 2), (1, 1), (2, 1), (3, 2), (5, 2)]
    assert rows(t1.in_degrees()) == [(0, 1), (1, 1), (2, 3), (3, 1), (6, 2)]
    assert rows(t1.degrees()) == [(0, 3), (1, 2), (2, 4), (3, 3), (5, 2), (6, 2)]
    assert rows(t1.degree_distribution()) == [(2, 3), (3, 2), (4, 1)]
    assert rows(t1.degree_distribution("total", 2)) == [(0, 2.0, 3.0, 3), (1, 3.0, 4.0, 3)]
    assert t1.num_vertices() == 7 and t1.vertices().count() == 7
    assert count_all(t1.edges, least=counter("weight", "min"), n=counter("src", "sum")) == {"least": 0.5, "n": 19}


def test_transforms(t1):
    assert rows(t1.transpose().transpose().edges) == sorted(EDGES)
    both = rows(t1.symmetrize().edges)
    assert both == sorted(EDGES + [(d, s, w) for s, d, w in EDGES]) and both.count((3, 3, 0.5)) == 2
    assert rows(t1.deduplicated().edges)[-1] == (5, 6, 2.0)
    assert [tuple(r.nbrs) for r in t1.unweighted().adjacency().orderBy("src").collect()] == [(1, 2), (2,), (0,), (2, 3), (6, 6)]
    with pytest.raises(ValueError):
        t1.directed("sideways")


@pytest.mark.parametrize("p", [1, 2, 3, 8])
def test_ids(spark, p):
    e = spark.range(50).select("id", global_id(local_id(F.col("id"), p), block_id(F.col("id"), p), p).alias("again"), local_id(F.col("id") + (1 << 60), p).alias("far"))
    assert all(r.id == r.again and r.far == (r.id + (1 << 60)) // p for r in e.collect())


def test_block_layout(t1):
    found = blocks.matrix_columns(t1.unweighted(), 2, 2)
    got = sorted((r.region, r.row_block * 2 + r.col_block, r.col, r.degree, tuple(r.rows)) for r in found.collect())
    # block of rows b and columns c: source id is 2 * col + c, destination 2 * row + b
    want = sorted(
        (("dense" if sum(s == x for s, _, _ in EDGES) >= 2 else "sparse"), (d % 2) * 2 + x % 2, x // 2, sum(s == x for s, _, _ in EDGES), tuple(sorted(y // 2 for s, y, _ in EDGES if s == x and y % 2 == d % 2)))
        for x, d in {(s, d % 2) for s, d, _ in EDGES}
    )
    assert got == want
    stats = rows(blocks.block_stats(found))
    assert sum(x[3] for x in stats) == 8 and sum(x[4] for x in stats) == len(want)
    assert rows(blocks.dense_vertices(t1, 2), "id") == [(0,), (3,), (5,)]


@pytest.mark.parametrize("threshold", [-1, 0, 2])
def test_blocks_round_trip(spark, t1, tmp_path, threshold):
    path = f"{tmp_path}/blocks"
    blocks.write_blocks(t1, path, 3, threshold)
    assert rows(blocks.read_blocks(spark, path).edges) == sorted(EDGES)
    regions = {r.region for r in blocks.read_columns(spark, path).select("region").collect()}
    assert regions == {-1: {"sparse"}, 0: {"dense"}, 2: {"sparse", "dense"}}[threshold]
    some = blocks.read_columns(spark, path, row_block=2, col_block=0)
    assert "PartitionFilters: [isnotnull(row_block" in some._jdf.queryExecution().toString()
    assert blocks.read_stats(spark, path).agg(F.sum("num_rows")).head()[0] == 8
    with pytest.raises(ValueError):
        blocks.read_columns(spark, path, col=1)


def write(tmp_path, content, name="in"):
    folder = tmp_path / name
    (folder / "deeper").mkdir(parents=True)
    (folder / "deeper" / "part").write_text(content)
    return str(folder)


def test_edge_lists(spark, tmp_path):
    assert rows(text.read_edge_list(spark, write(tmp_path, "0\t1\n5\t5\n5\t5\n", "a"))) == [(0, 1), (5, 5), (5, 5)]
    assert rows(text.read_edge_list(spark, write(tmp_path, "0,1,2.5\n", "b"), True, ",")) == [(0, 1, 2.5)]
    for i, bad in enumerate(("0\tx\n", "-1\t2\n", "0\n")):
        with pytest.raises(Exception):  # noqa: B017
            text.read_edge_list(spark, write(tmp_path, bad, f"bad{i}")).collect()


ADJACENCY = "0\t2 1 2\n1\t1 2\n2\t1 0\n3\t2 2 3\n5\t2 6 6\n9\t0\n8\t0 \n"


def test_adjacency_lists(spark, tmp_path):
    got = text.read_adjacency_list(spark, write(tmp_path, ADJACENCY, "a"))
    assert rows(got) == sorted((s, d) for s, d, _ in EDGES) and Graph(got).num_vertices() == 7
    assert rows(text.read_adjacency_list(spark, write(tmp_path, "0;2,1,2\n4;1,4\n", "b"), False, ";", ",")) == [(0, 1), (0, 2), (4, 4)]
    weighted = write(tmp_path, "0\t2 1 1.0 2 4.0\n7\t0\n3\t1 3 0.5\n", "c")
    assert rows(text.read_adjacency_list(spark, weighted, True)) == [(0, 1, 1.0), (0, 2, 4.0), (3, 3, 0.5)]
    for i, bad in enumerate(("0\t3 1 2\n", "0\t1 1 2\n", "x\t1 1\n", "0\t1 y\n", "0\t1 -1\n")):
        with pytest.raises(Exception):  # noqa: B017
            text.read_adjacency_list(spark, write(tmp_path, bad, f"bad{i}")).collect()


def test_cli(spark, tmp_path, capsys):
    adjacency = write(tmp_path, ADJACENCY, "adj")
    edges = write(tmp_path, "".join(f"{s}\t{d}\t{w}\n" for s, d, w in EDGES), "edges")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    out = lambda name: sorted((int(a), float(b)) for line in (tmp_path / name).glob("part-*") for a, b in (x.split("\t") for x in line.read_text().splitlines()))
    run("cc", adjacency, tmp_path / "cc", "--format", "adjlist")
    assert out("cc") == [*enumerate(GOLDEN["wcc"])] and '"converged": true' in capsys.readouterr().out
    run("pagerank", adjacency, tmp_path / "pr", "--format", "adjlist", "--max-iter", 2)
    assert all(abs(v - GOLDEN["pagerank 2"][i]) < 1e-9 for i, v in out("pr"))
    run("pagerank", adjacency, tmp_path / "rwr", "--format", "adjlist", "--max-iter", 2, "--source", 0)
    assert all(abs(v - GOLDEN["rwr 0 2"][i]) < 1e-9 for i, v in out("rwr"))
    run("partition", edges, tmp_path / "blocks", "-p", 2, "--weighted")
    run("sssp", tmp_path / "blocks", tmp_path / "sssp", "--format", "blocks", "--source", 3)
    assert out("sssp") == [(i, float("inf") if x is None else x) for i, x in enumerate(GOLDEN["sssp 3"])]
    run("degree", edges, tmp_path / "deg", "--weighted", "--kind", "out")
    assert out("deg") == [(0, 2), (1, 1), (2, 1), (3, 2), (5, 2)]
    assert rows(text.read_vector(spark, str(tmp_path / "deg"), "long")) == [(0, 2), (1, 1), (2, 1), (3, 2), (5, 2)]


@pytest.mark.parametrize("weighted", [False, True])
def test_adjacency_lists_round_trip(spark, t1, tmp_path, weighted):
    g = t1 if weighted else t1.unweighted()
    text.write_adjacency_list(g.edges, f"{tmp_path}/adj", ";", ",")
    assert rows(text.read_adjacency_list(spark, f"{tmp_path}/adj", weighted, ";", ",")) == rows(g.edges)


def test_bounded_histogram(t1):
    assert rows(t1.degree_distribution("total", 2, 1, 3)) == [(0, 1.0, 2.0, 0), (1, 2.0, 3.0, 5)][1:]
    assert rows(t1.degree_distribution("total", None, 3)) == [(3, 2), (4, 1)]
    assert rows(t1.degree_distribution("total", 3, 50)) == []
