import math
import os
import random

import pytest
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph, top_k
from meshwork.plans import gimv, programs, sketches
from meshwork.session import Scratch

EDGES = [(0, 1, 1.0), (0, 2, 4.0), (1, 2, 2.0), (2, 0, 1.0), (3, 2, 1.0), (3, 3, 0.5), (5, 6, 3.0), (5, 6, 2.0)]
INF = None
GOLDEN = {
    "pagerank 1": [0.188679245, 0.108490566, 0.349056604, 0.108490566, 0.028301887, 0.028301887, 0.188679245],
    "pagerank 2": [0.376297105, 0.125614418, 0.285772802, 0.086155106, 0.032768979, 0.032768979, 0.060622611],
    "pagerank": [0.316218308, 0.167161772, 0.333469819, 0.056989539, 0.032768977, 0.032768977, 0.060622608],
    "rwr 0 2": [0.51125, 0.06375, 0.425, 0, 0, 0, 0],
    "rwr 0": [0.452232894, 0.192198985, 0.355568121, 0, 0, 0, 0],
    "rwr 3": [0.28412023, 0.1207511, 0.334259104, 0.260869566, 0, 0, 0],
    "sssp 0": [0, 1, 3, INF, INF, INF, INF],
    "sssp 3": [2, 3, 1, 0, INF, INF, INF],
    "sssp 5": [INF, INF, INF, INF, INF, 0, 2],
    "wcc": [0, 0, 0, 0, 4, 5, 5],
    "label directed": [0, 0, 0, 3, 4, 5, 5],
    "label transposed": [0, 0, 0, 0, 4, 5, 6],
}
RUNS = {
    "pagerank 1": lambda g, **o: programs.pagerank(g, 1, **o), "pagerank 2": lambda g, **o: programs.pagerank(g, 2, **o), "pagerank": programs.pagerank,
    "rwr 0 2": lambda g, **o: programs.random_walk(g, 0, 2, **o), "rwr 0": lambda g, **o: programs.random_walk(g, 0, **o), "rwr 3": lambda g, **o: programs.random_walk(g, 3, **o),
    "sssp 0": lambda g, **o: programs.shortest_paths(g, 0, **o), "sssp 3": lambda g, **o: programs.shortest_paths(g, 3, **o), "sssp 5": lambda g, **o: programs.shortest_paths(g, 5, **o),
    "wcc": programs.connected_components, "label directed": programs.min_label, "label transposed": lambda g, **o: programs.min_label(g, "transposed", **o),
}
ROUNDS = {"pagerank 1": 1, "pagerank 2": 2, "pagerank": 34, "rwr 0 2": 2, "rwr 0": 37, "rwr 3": 36, "sssp 0": 3, "sssp 3": 4, "sssp 5": 2, "wcc": 3, "label directed": 2, "label transposed": 3}


@pytest.fixture(scope="module")
def t1(spark):
    return Graph.of(spark.createDataFrame(EDGES, "src long, dst long, weight double"))


def vector(result):
    rows = sorted(result.vector.collect())
    assert [r.id for r in rows] == list(range(len(rows)))
    return [r.value for r in rows]


@pytest.mark.parametrize("name", RUNS)
def test_golden(t1, name):
    result = RUNS[name](t1)
    for got, want in zip(vector(result), GOLDEN[name], strict=True):
        assert got == want if want is None or got is None else abs(got - want) < 1e-9
    assert result.iterations == ROUNDS[name]
    assert result.converged == (name not in ("pagerank 1", "pagerank 2", "rwr 0 2"))


@pytest.mark.parametrize("threshold", [-1, 0, 2, 100])
def test_placement_never_changes_results(t1, threshold):
    for name in ("pagerank 2", "sssp 3", "wcc"):
        got = vector(RUNS[name](t1, dense_threshold=threshold))
        assert all(a == b if b is None else abs(a - b) < 1e-9 for a, b in zip(got, GOLDEN[name], strict=True))
    assert vector(RUNS["wcc"](t1, dense_threshold=0, max_broadcast=1)) == GOLDEN["wcc"]


@pytest.mark.parametrize("unroll", [1, 3])
def test_rounds_at_once(t1, unroll):
    result = programs.shortest_paths(t1, 3, unroll=unroll, dense_threshold=-1)
    assert vector(result) == GOLDEN["sssp 3"] and result.iterations == 4


def test_cutoff(t1):
    degrees = t1.out_degrees()  # 2 1 1 2 2
    assert [gimv.cutoff(degrees, *a) for a in ((-1, 9), (0, 9), (2, 3), (0, 4), (0, 2), (9, 9))] == [None, 0, 2, 2, None, None]


def test_limits_and_sources(t1):
    assert programs.connected_components(t1, 0).iterations == 1  # at least one round
    assert vector(programs.shortest_paths(t1, 5, unreachable="sentinel"))[0] == programs.UNREACHABLE
    for source in (-1, 7):
        with pytest.raises(ValueError):
            programs.shortest_paths(t1, source)
        with pytest.raises(ValueError):
            programs.random_walk(t1, source)
    assert vector(programs.hops(t1, 3)) == [2, 3, 1, 0, None, None, None]
    assert vector(programs.max_label(t1)) == [3, 3, 3, 3, 4, 5, 6]


def test_empty_graph(spark):
    empty = Graph.of(spark.createDataFrame([], "src long, dst long"))
    for run in (programs.pagerank, programs.connected_components):
        assert run(empty).vector.collect() == []


def random_graph(spark, seed, n=40, m=120):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), min(rng.randrange(n), rng.randrange(n)), float(rng.randint(1, 9))) for _ in range(m)]
    return edges, Graph.of(spark.createDataFrame(edges, "src long, dst long, weight double"))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    edges, g = random_graph(spark, seed)
    n = max(max(s, d) for s, d, _ in edges) + 1
    ranks = [1 / n] * n
    out = [sum(s == i for s, _, _ in edges) for i in range(n)]
    for _ in range(3):
        sums = [0.0] * n
        for s, d, _ in edges:
            sums[d] += ranks[s] / out[s]
        ranks = [0.85 * x + 0.15 / n for x in sums]
    got = vector(programs.pagerank(g, 3, dense_threshold=4))
    assert all(abs(a - b / sum(ranks)) < 1e-9 for a, b in zip(got, ranks, strict=True)) and abs(sum(got) - 1) < 1e-9
    dist = [math.inf] * n
    dist[0] = 0.0
    for _ in range(n):
        for s, d, w in edges:
            dist[d] = min(dist[d], dist[s] + w)
    found = [math.inf if x is None else x for x in vector(programs.shortest_paths(g, 0))]
    assert found == dist and all(found[d] <= found[s] + w for s, d, w in edges)
    assert vector(programs.connected_components(g)) == vector(programs.connected_components(g.transpose()))


def test_own_program(t1):
    """Counts of in-edges, as a program: one round of ones."""
    ones = gimv.Program(init=lambda ctx, i: F.lit(0.0), combine2=lambda ctx, v, degree, w: F.lit(1.0), combine_all=F.sum, apply=lambda ctx, i, old, m: F.coalesce(m, F.lit(0.0)), changed=lambda ctx, old, new: old != new)
    result = gimv.run(t1, ones, dense_threshold=2)
    assert vector(result) == [1, 1, 3, 1, 0, 0, 2] and result.iterations == 2 and len(result.job_ms) == 2
    assert [r.id for r in top_k(result.vector, 2).collect()] == [2, 6]


@pytest.mark.parametrize("threshold", [-1, 0, 3])
def test_frontier_gives_the_same_rounds(spark, threshold):
    """Broadcast frontiers, from the second round on, against joins of all edges."""
    edges, g = random_graph(spark, 5)
    for run in (lambda **o: programs.shortest_paths(g, 0, **o), lambda **o: programs.connected_components(g, **o), lambda **o: programs.min_label(g, "transposed", 4, **o)):
        plain = run(frontier_share=0.0, dense_threshold=threshold)
        few = run(frontier_share=100.0, frontier_from=0, dense_threshold=threshold, unroll=1)
        assert vector(plain) == vector(few) and plain.iterations == few.iterations and plain.converged == few.converged
        assert [job.rounds for job in few.jobs] == [1] * len(few.jobs) and set(few.iteration_ms) == set(range(1, len(few.jobs) + 1))


def test_context_and_hooks(t1):
    """Builders see the round and the limit; hooks see each job."""
    seen = []
    program = gimv.Program(
        init=lambda ctx, i: F.lit(float(ctx.iteration)), combine2=lambda ctx, v, degree, w: F.lit(0.0), combine_all=F.sum,
        apply=lambda ctx, i, old, m: old + ctx.iteration * 10 ** (ctx.max_iter - ctx.iteration), changed=lambda ctx, old, new: F.lit(ctx.iteration < 3) | (F.col("id") == 0),
        before=lambda ctx, v: seen.append((ctx.iteration, v.count())), after=lambda ctx, v: seen.append((ctx.iteration, v.filter(F.col("changed_at") == ctx.iteration).count())),
    )
    result = gimv.run(t1, program, 3, unroll=2)
    assert vector(result) == [123.0] + [120.0] * 6 and seen == [(0, 7), (2, 7), (3, 1)]
    assert [(job.first, job.rounds, job.changed) for job in result.jobs] == [(1, 2, 7), (3, 1, 1)] and not result.converged


@pytest.mark.parametrize("seed", [3, 4])
def test_contracted_components(spark, seed):
    edges, g = random_graph(spark, seed, 60, 45)
    assert [r.value for r in programs.contracted_components(g).orderBy("id").collect()] == vector(programs.connected_components(g))
    chain = Graph.of(spark.createDataFrame([(i, i + 1) for i in range(14)] + [(20, 20)], "src long, dst long"))
    assert [r.value for r in programs.contracted_components(chain).orderBy("id").collect()] == [0] * 15 + [*range(15, 21)]
    assert programs.contracted_components(Graph.of(spark.createDataFrame([], "src long, dst long"))).collect() == []


def test_neighbourhood(spark):
    """Estimates against a search from every vertex."""
    edges, g = random_graph(spark, 6, 50, 90)
    n = max(max(s, d) for s, d, _ in edges) + 1
    within, exact = [{i} for i in range(n)], []
    while not exact or sum(map(len, within)) > exact[-1]:
        exact.append(sum(map(len, within)))
        within = [w.union(*({d} | within[d] for s, d, _ in edges if s == i)) for i, w in enumerate(within)]
    got = programs.neighbourhood(g, log_size=12)
    assert len(got) == len(exact) and all(abs(a - b) <= 0.02 * b for a, b in zip(got, exact, strict=True))
    assert programs.neighbourhood(g, 1, 12) == got[:2]
    assert programs.effective_diameter([10.0, 20.0, 40.0]) == 1.8 and programs.effective_diameter([3.0]) == 0.0 and math.isnan(programs.effective_diameter([]))


def test_neighbourhood_room(spark, monkeypatch):
    """However many rounds there are, tables of rounds that are over go; many small blocks give what one gives."""
    chain = Graph.of(spark.createDataFrame([(i, i + 1) for i in range(11)] + [(11, 9), (3, 3), (0, 1)], "src long, dst long"))
    write, seen = Scratch.write, []

    def watched(self, df):
        out = write(self, df)
        seen.append(len([f for f in os.listdir(self.folder.removeprefix("file:")) if f.isdigit()]))
        return out

    monkeypatch.setattr(Scratch, "write", watched)
    got = programs.neighbourhood(chain, 5, 12)
    # of vertices 0 to 11, those within 0 to 5 edges; 9, 10 and 11 are a ring
    assert [round(x) for x in got] == [12, 24, 36, 45, 53, 60]
    assert len(seen) >= 6 and max(seen) <= 2
    monkeypatch.setattr(sketches, "block_count", lambda n, log_size: 5)
    assert programs.neighbourhood(chain, 5, 12) == pytest.approx(got)


def test_neighbourhood_hub(spark):
    """A vertex that many blocks hear of, and one that hears of them all."""
    spokes = [(i, 0) for i in range(1, 1200)] + [(1200, i) for i in range(1, 1200)]
    got = programs.neighbourhood(Graph.of(spark.createDataFrame(spokes, "src long, dst long")), log_size=14)
    assert got == pytest.approx([1201, 1201 + 2 * 1199, 1202 + 2 * 1199], rel=0.02) and programs.neighbourhood(Graph.of(spark.createDataFrame([], "src long, dst long"))) == [0.0]
