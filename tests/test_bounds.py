"""Kernels against their forms by joins, and what happens beyond the bound of a network that is sent to workers."""

import random

import pytest
from pyspark.sql import functions as F

from slopewise.operators import components, paths, sidewalks, topology
from tests.test_components import brute

ARC = "src long, dst long, arc_id long, cost double, climb double"


@pytest.fixture(scope="module")
def arcs(spark):
    rng = random.Random(6)
    # Costs are powers of two apart from the rest, so that no two ways cost the same.
    return spark.createDataFrame([(rng.randrange(25), rng.randrange(25), i, 1.0 + rng.random(), rng.random()) for i in range(90)], ARC).cache()


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(paths, "MOST_BYTES", 100)


def rows(df):
    return sorted(map(str, df.collect()))


def test_routes_by_joins_are_those_of_the_kernel(spark, arcs, monkeypatch):
    asked = spark.createDataFrame([(1, 0, 7), (2, 0, 9), (3, 5, 0), (4, 3, 3), (5, 2, 999), (6, 999, 1)], "request long, source long, target long")
    want = paths.routes(arcs, asked, ("cost", "climb"))
    tidy = lambda df: rows(df.select("objective", "request", "source", "target", F.round("cost", 9).alias("cost"), "arcs"))
    expect = tidy(want)
    assert len(expect) >= 6
    assert tidy(paths.routes_by_joins(arcs, asked, ("cost", "climb"))) == expect
    monkeypatch.setattr(paths, "MOST_BYTES", 100)
    assert tidy(paths.routes(arcs, asked, ("cost", "climb"))) == expect


def test_budgets_by_joins_are_those_of_the_kernel(spark, arcs, monkeypatch):
    rng = random.Random(7)
    asked = spark.createDataFrame([(i, rng.randrange(25), rng.randrange(25), rng.random() * 8) for i in range(40)], "request long, source long, target long, budget double")
    want = rows(paths.within(arcs, asked))
    assert 5 < len(want) < 40
    monkeypatch.setattr(paths, "MOST_BYTES", 100)
    assert rows(paths.within(arcs, asked)) == want


def test_searches_without_joins_raise_beyond_the_bound(spark, arcs, tiny):
    asked = spark.createDataFrame([(1, 0, 7)], "request long, source long, target long")
    with pytest.raises(ValueError):
        paths.frontier(arcs, asked, "cost", "climb")
    with pytest.raises(ValueError):
        paths.round_trips(arcs.withColumns({"gain": F.col("climb"), "x": F.col("dst"), "y": F.col("dst")}), asked)


def edges_of(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n), float(rng.randrange(12)), i) for i in range(m)]


def test_forest_by_joins_and_pass_heights(spark):
    rng = random.Random(8)
    edges = edges_of(rng, 40, 70)
    df = spark.createDataFrame(edges, "u long, v long, crest double, edge_id long")
    kernel, joins = rows(topology.spanning_forest(df).select("edge_id")), rows(topology.forest_by_joins(df).select("edge_id"))
    assert kernel == joins and 10 < len(kernel) < 40

    def height(a, b):
        for crest, edge in sorted((c, e) for _, _, c, e in edges):
            held = brute([(u, v) for u, v, c, e in edges if (c, e) <= (crest, edge)])
            if a in held and held[a] == held.get(b):
                return crest, edge
        return None

    pairs = [(a, b) for a in range(0, 40, 3) for b in range(1, 40, 5) if a != b]
    got = {(r.a, r.b): (r.height, r.edge_id) for r in topology.pass_heights(df, spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {p: h for p in pairs if (h := height(*p)) is not None}
    assert got == want and len(want) > 20


def test_deep_merge_trees_are_climbed_in_jumps():
    import pandas as pd

    chain = pd.DataFrame({"u": range(3000), "v": range(1, 3001), "crest": [float(k) for k in range(3000)], "edge_id": range(3000)})
    tree = topology.MergeTree(chain)
    assert max(tree.depth) >= 2999
    assert all(tree.height(a, b) == (float(max(a, b) - 1), max(a, b) - 1) for a, b in ((0, 1), (5, 2000), (2999, 7), (3000, 0)))
    assert tree.height(0, 99_999) is None


def test_components_in_one_task_and_beyond(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5001 + i, 5000) for i in range(50)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = brute([(a, b) for a, b in edges if a != b])
    assert {r.node: r.component for r in components.network_components(df).collect()} == want
    monkeypatch.setattr(components, "MOST_LINKS", 10)
    assert {r.node: r.component for r in components.network_components(df).collect()} == want
    assert components.network_components(df.limit(0)).collect() == []


def test_shortcuts_and_put_back_sidewalks_stay(spark):
    """A street along y = 0 with sidewalks beside it; one bridges a gap in the street, one leads to steps, one only follows."""
    place = {1: (0, 0), 2: (50, 0), 3: (100, 0), 4: (200, 0), 5: (250, 0), 11: (0, 5), 12: (50, 5), 13: (100, 5), 14: (200, 5), 20: (150, 60)}
    def edge(i, u, v, cls):
        (a, b), (c, d) = place[u], place[v]
        return (i, u, v, ((a - c) ** 2 + (b - d) ** 2) ** 0.5, cls, float(a), float(b), float(c), float(d))
    streets = [edge(1, 1, 2, "s"), edge(2, 2, 3, "s"), edge(4, 4, 5, "s")]
    walks = [edge(10, 11, 12, "f"), edge(11, 12, 13, "f"), edge(12, 13, 14, "f")]
    links = [edge(20, 1, 11, "f"), edge(21, 3, 13, "f"), edge(22, 4, 14, "f"), edge(23, 14, 20, "steps")]
    make = lambda r: spark.createDataFrame(r, "edge_id long, u long, v long, len double, cls string, x0 double, y0 double, x1 double, y1 double")
    longer = streets + [edge(3, 3, 4, "s")]
    for base, kept in ((streets, True), (longer, False)):
        all_edges, cand = make(base + walks + links), make(walks)
        got = {r.edge_id for r in sidewalks.drop_sidewalks(all_edges.select("edge_id", "u", "v", "len"), cand.drop("cls"), make(base).drop("cls")).collect()}
        assert {1, 2, 4, 23} <= got and 10 not in got and 11 not in got
        assert (12 in got) == kept
