"""Polygons: repair, measures, labels and reach."""

import random

from pyspark.sql import functions as F

from slopewise.functions import geometry, text
from slopewise.operators import spatial

RING = "array<struct<x: double, y: double>>"
U = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (8.0, 10.0), (8.0, 2.0), (2.0, 2.0), (2.0, 10.0), (0.0, 10.0)]


def test_repair_and_measures(spark):
    rows = spark.createDataFrame([(1, U), (2, [*U, U[0]]), (3, [U[0], U[0], *U[1:], U[-1]]), (4, [(1.0, 1.0), (1.0, 1.0)]), (5, []), (6, None), (7, [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)])], f"id long, ring {RING}")
    ring = geometry.repaired(F.col("ring"))
    got = {r.id: r for r in rows.select("id", ring.alias("ring")).select("*", geometry.area(F.col("ring")).alias("area"), geometry.centroid(F.col("ring")).alias("c"), geometry.representative(F.col("ring")).alias("p")).collect()}
    assert got[1].ring == got[2].ring == got[3].ring and len(got[1].ring) == 9
    assert got[4].ring is None and got[5].ring is None and got[6].ring is None
    assert got[1].area == 52 and got[7].area == 6
    assert abs(got[7].c.x - 4 / 3) < 1e-9 and abs(got[7].c.y - 1) < 1e-9
    inside = rows.where("id in (1, 7)").select(geometry.repaired(F.col("ring")).alias("ring")).withColumn("p", geometry.representative(F.col("ring")))
    assert all(r.ok for r in inside.select(geometry.inside(F.col("ring"), F.col("p.x"), F.col("p.y")).alias("ok")).collect())


def test_labels_and_reach_match_plain_search(spark):
    rng = random.Random(3)
    rings = [(k, [(x, y), (x + 9.0, y + 1), (x + 7.0, y + 8), (x + 3.0, y + 3), (x, y)]) for k, (x, y) in enumerate([(0.0, 0.0), (5.0, 2.0), (20.0, -4.0)])]
    points = [(i, rng.uniform(-6, 32), rng.uniform(-10, 16)) for i in range(400)]

    def within(ring, x, y):
        return sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:], strict=False)) % 2 == 1

    def gap(ring, x, y):
        best = 1e9
        for (a, b), (c, d) in zip(ring, ring[1:], strict=False):
            t = max(0, min(1, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
            best = min(best, ((x - a - t * (c - a)) ** 2 + (y - b - t * (d - b)) ** 2) ** 0.5)
        return best

    df, shapes = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(rings, f"name long, ring {RING}")
    got = {r.id: r["name"] for r in spatial.label_polygons(df, shapes, "id", "name", 4.0).collect()}
    assert got == {i: min((k for k, ring in rings if within(ring, x, y)), default=None) for i, x, y in points}
    near = {r.id: r.inside for r in spatial.within_reach(df, shapes, "id", 1.5).collect()}
    assert near == {i: any(within(ring, x, y) or gap(ring, x, y) <= 1.5 for _, ring in rings) for i, x, y in points}


def test_every_point_is_snapped_however_far(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0)], "node long, x double, y double")
    points = spark.createDataFrame([(1, 1.0, 0.0), (2, 1e9, 5.0), (3, -4e8, 1e8)], "p long, x double, y double")
    got = {r.p: (r.node, r.kind) for r in spatial.snap(points, nodes.where("node = 1"), nodes, "p", "node", 5.0).collect()}
    assert got == {1: (1, "corner"), 2: (2, "node"), 3: (1, "node")}
    assert spatial.snap(points, nodes.limit(0), nodes.limit(0), "p", "node", 5.0).collect() == []


def test_kinds_groups_and_units(spark):
    rows = spark.createDataFrame([("land", "peak"), ("land_use", "allotments"), ("land", "park"), ("road", "peak"), (None, None)], "t string, c string")
    assert [r.k for r in rows.select(text.kind_of(F.col("t"), F.col("c")).alias("k")).collect()] == ["peak", "community garden", None, None, None]
    categories = ["scenic_point", "ice_cream_shop", "elementary_school", "farmers_market", "swimming_pool", "public_transportation", "night_market", "office"]
    groups = spark.createDataFrame([(c,) for c in categories], "c string").select(text.group_of(F.col("c")).alias("g"))
    assert [r.g for r in groups.collect()] == ["park", "food", "school", "shop", "civic", "transit", "landmark", None]
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (5 * 1024**4 + 1,)], "n long").select(text.human_bytes(F.col("n")).alias("s"))
    assert [r.s for r in sizes.collect()] == ["0.0 B", "1,023.0 B", "1.5 KB", "5.0 TB"]
    long = "A" * 12_000
    assert spark.createDataFrame([(long,)], "s string").select(text.title_street(F.col("s")).alias("s")).first().s == "A" + "a" * 11_999
