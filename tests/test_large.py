"""What must hold for tables that are large, tried on small ones: what is broadcast, and what goes through the driver."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from slopewise.functions import geometry
from slopewise.operators import corridors, packing, paths, places
from slopewise.plans import streets
from slopewise.sources import street_network as net

TABLES = "/root/testdata/sf0.001"
#: Queries over places that join tables as large as `part` or larger.
PLACES = ["place_support", "place_keep", "place_best", "superseded", "prune_variants", "search"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLACES)
def test_places_are_merged_not_broadcast(spark, monkeypatch, name):
    plans, cut = [], places.cut
    monkeypatch.setattr(places, "cut", lambda df: (plans.append(plan(df)), cut(df))[1])
    whole = plan(entry.queries()[name](spark, TABLES))
    first = plans[0] if plans else whole  # later rounds come from checkpoints
    assert "SortMergeJoin" in first
    assert not re.findall(r"BroadcastHashJoin \[(?:n|m|mx|place|v|start|__c|__h|o_custkey)#.*", first)


#: Queries over routes, whose network must not pass through the driver.
ROUTES = ["edge_usage", "flat_route", "trip_comparison", "route_geometry", "route_profile", "point_along_route", "edge_scores", "default_trip", "barriers", "corridors", "route_summary", "mean_by_profile", "pareto_front", "bike_route_summary", "corridor_material", "top_barriers", "run_summary"]


@pytest.mark.parametrize("name", ROUTES)
def test_networks_reach_workers_past_the_driver(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("the network went through the driver")

    stored, held = [], paths.Stored
    monkeypatch.setattr(paths.Network, "of", never)
    monkeypatch.setattr(paths, "Stored", lambda *a: (stored.append(held(*a)), stored[-1])[1])
    entry.queries()[name](spark, TABLES)
    assert len(stored) == 1


def test_many_trees_at_once_are_the_single_ones(monkeypatch):
    rng = np.random.default_rng(3)
    n, m = 60, 240
    src, dst = rng.integers(0, n, (2, m))
    net = paths.Network(src, dst, np.arange(m), 1.0 + 30 * rng.random(m) ** 4)
    sources = list(range(0, len(net.ids), 3))
    for cells in (1 << 23, 2 * len(net.ids)):
        monkeypatch.setattr(paths, "MOST_CELLS", cells)
        for source, (cost, via) in zip(sources, net.trees(sources), strict=True):
            want, by = net.tree(source)
            assert np.array_equal(cost, want) and np.array_equal(via, by)
        ends = [{1, 5, 7}] * len(sources)
        for source, (cost, via) in zip(sources, net.trees(sources, ends), strict=True):
            want, by = net.tree(source)
            assert all(cost[t] == want[t] and net.path(via, t) == net.path(by, t) for t in ends[0])


def test_costs_are_held_one_at_a_time(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k + 1, k, 1.0, 2.0, 3.0) for k in range(30)], "src long, dst long, arc_id long, a double, b double, c double")
    monkeypatch.setattr(paths, "MOST_BYTES", 30 * 8 * 4)
    monkeypatch.setattr(paths, "routes_by_joins", None)
    got = paths.routes(rows, spark.createDataFrame([(1, 0, 30)], "request long, source long, target long"), ("a", "b", "c")).collect()
    assert {r.objective: (r.cost, r.arcs) for r in got} == {k: (30.0 * v, list(range(30))) for k, v in (("a", 1), ("b", 2), ("c", 3))}


def test_packing_goes_past_the_driver(spark, monkeypatch):
    n, e, a = net.nodes(spark, TABLES), net.edges(spark, TABLES), net.arcs(spark, TABLES)
    corners = n.select("node", "x", "y", "z", geometry.morton(F.col("col"), F.col("row")).alias("k")).toPandas().sort_values(["k", "node"], ignore_index=True)
    streets = e.select("edge_id", "len", "name", "cls").toPandas().sort_values("edge_id", ignore_index=True)
    ways = a.toPandas()
    ways["s"], ways["t"] = (ways[c].map({v: i for i, v in enumerate(corners["node"])}) for c in ("src", "dst"))
    ways = ways.sort_values(["s", "arc_id"])

    def never(*_):
        raise AssertionError("the network went through the driver")

    for name in ("toPandas", "toArrow"):
        monkeypatch.setattr(type(n), name, never)
    arrays, strings = packing.read_bundle(packing.pack_network(n, e, a))
    assert strings == {"names": sorted(streets["name"].unique()), "classes": sorted(streets["cls"].unique())}
    for c in "xyz":
        assert np.array_equal(arrays[c], corners[c])
    assert np.array_equal(np.repeat(np.arange(len(corners)), np.diff(arrays["first"])), ways["s"])
    assert np.array_equal(arrays["head"], ways["t"]) and np.array_equal(arrays["gain"], ways["gain"])
    assert np.array_equal(arrays["flags"], ways["walk"] + 2 * ways["bike"] + 4 * (ways["direction"] == "rev"))
    assert np.array_equal(streets["edge_id"].to_numpy()[arrays["edge"]], ways["edge_id"]) and np.array_equal(arrays["len"], streets["len"])
    assert [strings["names"][i - 1] for i in arrays["name"]] == list(streets["name"]) and [strings["classes"][i] for i in arrays["cls"]] == list(streets["cls"])


def test_ways_of_many_searches_are_those_of_single_trees(monkeypatch):
    rng = np.random.default_rng(4)
    n, m = 80, 260
    src, dst = rng.integers(0, n, (2, m))
    for costs in (1.0 + 30 * rng.random(m) ** 4, rng.integers(1, 4, m).astype(float), rng.integers(0, 3, m).astype(float)):  # the second has many ways that cost the same
        net = paths.Network(src, dst, np.arange(m)[::-1], costs)
        sources = list(range(0, len(net.ids), 3))
        ends = [{s, 1, 5, 7, 30} for s in sources[:-1]] + [set()]
        for cells in (1 << 23, 2 * len(net.ids)):
            monkeypatch.setattr(paths, "MOST_CELLS", cells)
            for source, wanted, ways in zip(sources, ends, net.ways(sources, ends), strict=True):
                cost, _ = net.tree(source)
                assert ways.keys() == {t for t in wanted if np.isfinite(cost[t])}
                if costs.min() > 0:
                    _, via = next(net.trees([source]))
                    assert all(ways[t][0] == cost[t] and list(ways[t][1]) == net.path(via, t) for t in ways)


def test_routes_make_no_tree_of_predecessors(monkeypatch):
    """Of a tree over all nodes few arcs are asked for, so ways are followed back instead."""

    def never(*_):
        raise AssertionError("predecessors of all nodes were made")

    monkeypatch.setattr(paths.Network, "trees", never)
    line = paths.Network(np.arange(9), np.arange(1, 10), np.arange(9), np.ones(9))
    assert list(next(line.ways([0], [{9}]))[9][1]) == list(range(9))
    assert [c.tolist() for c in line.settled([7])] == [[[np.inf] * 7 + [0.0, 1.0, 2.0]]]


def test_streets_are_joined_once(spark):
    whole = plan(net.edges(spark, TABLES))
    assert whole.count("SortMergeJoin") == 1 and "Union" not in whole
    rows = net.arcs(spark, TABLES).select("arc_id", "edge_id", net.edge_of("arc_id").alias("by_number")).collect()
    assert all(r.edge_id == r.by_number for r in rows) and any(r.edge_id >= net.PARALLEL for r in rows)


def test_usage_is_dealt_out_by_edge_once(spark):
    steps = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (1, "b", 5), (2, "a", 5), (2, "a", 6), (3, "a", 6)], "request long, objective string, edge_id long")
    trips = spark.createDataFrame(
        [(1, "a", 0, 1, 10, 0.5), (1, "b", 0, 1, -4, None), (2, "a", 1, 0, 7, 0.25), (3, "a", 2, 0, None, None)],
        "request long, objective string, origin long, destination long, saved long, efficiency double",
    )
    got = corridors.usage(steps, F.broadcast(trips))
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in got.collect()} == {(5, 2, 2, 17, 0.375), (6, 2, 3, 7, 0.25)}


@pytest.mark.parametrize("rank", [0, 2, 10**6])
def test_access_points_of_every_rank(spark, rank):
    e, n = net.edges(spark, TABLES).toPandas(), net.nodes(spark, TABLES).toPandas().set_index("node")
    facts: dict = {}
    for r in e.itertuples():
        for v in (r.u, r.v):
            f = facts.setdefault(v, [0, 0, False, False])
            f[0], f[1], f[2], f[3] = f[0] + 1, f[1] + r.len, f[2] or r.cls in ("residential", "secondary"), f[3] or bool(r.name)
    want = {}
    for hood, of in n.loc[list(facts)].groupby("hood"):
        total = sum(facts[v][1] for v in of.index)
        cx, cy = (sum(of[c][v] * facts[v][1] for v in of.index) / total for c in "xy")
        tier = lambda f: 1 if f[0] >= 3 and f[2] and f[3] else 2 if f[0] >= 3 and f[2] else 3 if f[2] else 4 if f[0] >= 3 else 5
        order = sorted((tier(facts[v]), round((of.x[v] - cx) ** 2 + (of.y[v] - cy) ** 2, 3), v) for v in of.index)
        want[hood] = order[min(rank, len(order) - 1)][2]
    assert {r.hood: r.node for r in streets.access_points(spark, TABLES, rank).collect()} == want


def test_the_default_trip_searches_what_it_needs(spark, monkeypatch):
    asked, routes = [], paths.routes
    monkeypatch.setattr(paths, "routes", lambda arcs, requests, costs: (asked.append(costs), routes(arcs, requests, costs))[1])
    entry.queries()["default_trip"](spark, TABLES)
    assert asked == [("shortest", "balanced")]
