import itertools
import random

import numpy as np
import pytest

from slopewise.operators import costs, paths, topology

ARC = "src long, dst long, arc_id long, cost double"


def diamond(spark):
    """A-B-D is 600 long and climbs 45, of it 300 above eight percent; A-C-D is 1200 long and climbs 3."""
    base = dict(cls="residential", gain=0.0, len=100.0, d_above_3=0.0, d_above_5=0.0, d_above_8=0.0, d_above_10=0.0, d_above_15=0.0)
    rows = [(0, 1, 0, base | dict(len=300.0, gain=22.0, d_above_3=150.0, d_above_5=150.0, d_above_8=150.0)), (1, 3, 1, base | dict(len=300.0, gain=23.0, d_above_3=150.0, d_above_5=150.0, d_above_8=150.0)), (0, 2, 2, base | dict(len=600.0, gain=1.0)), (2, 3, 3, base | dict(len=600.0, gain=2.0))]
    return spark.createDataFrame([(s, d, a, *x.values()) for s, d, a, x in rows], "src long, dst long, arc_id long, cls string, gain double, len double, d_above_3 double, d_above_5 double, d_above_8 double, d_above_10 double, d_above_15 double")


@pytest.mark.parametrize("objective, arcs", [(costs.SHORTEST, [0, 1]), (costs.MIN_CLIMB, [2, 3]), (costs.GRADE_AVERSE, [2, 3]), (costs.BALANCED, [2, 3])])
def test_diamond(spark, objective, arcs):
    rows = diamond(spark).withColumn("cost", costs.arc_cost(objective, "walk"))
    asked = spark.createDataFrame([(1, 0, 3), (2, 0, 0), (3, 3, 0), (4, 0, 99)], "request long, source long, target long")
    got = {r.request: r.arcs for r in paths.routes(rows, asked).collect()}
    assert got == {1: arcs, 2: []}


def test_parallel_arcs_take_the_shorter_and_ties_the_later(spark):
    rows = spark.createDataFrame([(0, 1, 5, 400.0), (0, 1, 6, 100.0), (1, 2, 7, 50.0), (1, 2, 8, 50.0)], ARC)
    assert {(r.src, r.dst, r.arc_id, r.cost) for r in costs.best_parallel(rows).collect()} == {(0, 1, 6, 100.0), (1, 2, 8, 50.0)}
    assert {r.node: r.cost for r in paths.distances(rows, spark.createDataFrame([(0,)], "source long")).collect()} == {0: 0.0, 1: 100.0, 2: 150.0}


def random_arcs(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n), i, float(rng.randrange(1, 50)), float(rng.randrange(0, 20))) for i in range(m)]


def test_kernel_and_joins_agree(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([r[:4] for r in random_arcs(rng, 30, 90)], ARC)
    sources = spark.createDataFrame([(0,), (5,)], "source long")
    key = lambda df: sorted((r.source, r.node, r.cost) for r in df.collect())
    assert key(paths.distances(rows, sources)) == key(paths.distances_by_joins(rows, sources))


def test_frontier_has_every_trade_off(spark):
    rng = random.Random(9)
    arcs = random_arcs(rng, 8, 26)
    rows = spark.createDataFrame(arcs, "src long, dst long, arc_id long, a double, b double")
    got = {(r.first, r.second) for r in paths.frontier(rows, spark.createDataFrame([(1, 0, 7)], "request long, source long, target long"), "a", "b").collect()}
    every = set()
    for k in range(0, 7):
        for middle in itertools.permutations(range(1, 7), k):
            stops = [0, *middle, 7]
            fans = [[(x[3], x[4]) for x in arcs if (x[0], x[1]) == leg] for leg in itertools.pairwise(stops)]
            every |= {(sum(c[0] for c in choice), sum(c[1] for c in choice)) for choice in itertools.product(*fans)} if all(fans) else set()
    assert got == {p for p in every if not any(q != p and q[0] <= p[0] and q[1] <= p[1] for q in every)}


def test_thin_keeps_ends(spark):
    df = spark.createDataFrame([(1, float(i), float(500 - i), [i]) for i in range(200)], "request long, first double, second double, arcs array<long>")
    kept = sorted(r.first for r in paths.thin(df, 30).collect())
    assert len(kept) <= 30 and kept[0] == 0.0 and kept[-1] == 199.0


def test_non_dominated_keeps_equal_rows(spark):
    rows = [("k", 1, 5), ("k", 1, 5), ("k", 2, 5), ("k", 3, 1), (None, 9, 9)]
    got = paths.non_dominated(spark.createDataFrame(rows, "k string, a long, b long"), ["k"], ["a", "b"]).collect()
    assert sorted((str(r.k), r.a, r.b) for r in got) == [("None", 9, 9), ("k", 1, 5), ("k", 1, 5), ("k", 3, 1)]


def test_comparisons(spark):
    rows = [("walk", "shortest", 1, 2, 1000, 0), ("walk", "balanced", 1, 2, 1500, 0), ("walk", "balanced", 1, 3, 10, 5)]
    got = {(r.objective, r.destination): r for r in paths.comparisons(spark.createDataFrame(rows, "mode string, objective string, origin long, destination long, distance long, gain long")).collect()}
    assert got["balanced", 2].detour_ratio == 1.5 and got["balanced", 2].saved_pct == 0.0 and got["shortest", 2].efficiency is None
    assert got["balanced", 3].detour is None and got["balanced", 3].saved_pct is None


def valleys(spark):
    """Two valleys joined over a col at 40 and a ridge at 95."""
    edges = [(0, 0, 1, 4.0), (1, 1, 2, 40.0), (2, 2, 3, 40.0), (3, 3, 4, 6.0), (4, 0, 5, 95.0), (5, 5, 4, 95.0)]
    heights = [(0, 0.0), (1, 4.0), (2, 40.0), (3, 6.0), (4, 2.0), (5, 95.0)]
    return spark.createDataFrame([(*e, 1000.0) for e in edges], "edge_id long, u long, v long, crest double, len double"), spark.createDataFrame(heights, "node long, z double")


def test_pass_heights(spark):
    edges, _ = valleys(spark)
    pairs = spark.createDataFrame([(0, 4), (4, 0), (0, 1), (0, 9)], "a long, b long")
    got = {(r.a, r.b): r.height for r in topology.pass_heights(edges, pairs).collect()}
    assert got == {(0, 4): 40.0, (4, 0): 40.0, (0, 1): 4.0}


def test_basins_and_their_pass(spark):
    edges, heights = valleys(spark)
    found = topology.basins(edges, heights, 15.0, 50.0)
    assert {frozenset(r.node for r in found.collect() if r.basin == b) for b in (0, 3)} == {frozenset({0, 1}), frozenset({3, 4})}
    assert topology.basins(edges, heights, 15.0, 10_000.0).collect() == []
    joined = topology.basin_passes(edges, found).collect()
    assert len(joined) == 1 and joined[0].crest == 40.0


def test_strong_components(spark):
    arcs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0)]
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(arcs)], "src long, dst long, arc_id long")
    assert sorted(r.node for r in topology.largest_strong_component(rows).collect()) == [0, 1, 2]


def test_strong_components_by_reach_agree(spark, monkeypatch):
    rng = random.Random(4)
    rows = spark.createDataFrame([(rng.randrange(25), rng.randrange(25), i) for i in range(45)], "src long, dst long, arc_id long")
    whole = sorted(r.node for r in topology.largest_strong_component(rows).collect())
    monkeypatch.setattr(topology, "fits", lambda arcs: False)
    assert len(topology.largest_strong_component(rows).collect()) == len(whole)


def test_loops_keep_their_promises(spark):
    n = 12
    arcs = []
    for r, c in itertools.product(range(n), range(n)):
        for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            if 0 <= r + dr < n and 0 <= c + dc < n:
                arcs.append((r * n + c, (r + dr) * n + c + dc, len(arcs), 100.0, float(abs(dr) * 2), (c + dc) * 100.0, (r + dr) * 100.0))
    rows = spark.createDataFrame(arcs, "src long, dst long, arc_id long, cost double, gain double, x double, y double")
    got = paths.round_trips(rows, spark.createDataFrame([(1, 78, 2000.0)], "request long, source long, wish double")).orderBy("rank").collect()
    ends = {a[2]: (a[0], a[1]) for a in arcs}
    assert got
    for r in got:
        assert abs(r.distance - 2000) <= 240 and ends[r.arcs[0]][0] == ends[r.arcs[-1]][1] == 78
        assert all(ends[a][1] == ends[b][0] for a, b in itertools.pairwise(r.arcs))
    assert [r.gain for r in got] == sorted(r.gain for r in got)
    assert np.isfinite([r.gain for r in got]).all()
