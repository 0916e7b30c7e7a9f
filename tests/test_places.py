import numpy as np
import pytest
from pyspark.sql import functions as F

from slopewise.functions import geometry, text
from slopewise.operators import packing, places, sidewalks, warp
from slopewise.sources import files


@pytest.mark.parametrize("raw, title", [("JOHN MUIR DR", "John Muir Dr"), ("24TH AVE N", "24th Ave N"), ("N 9TH ST", "N 9th St"), ("NORTH  POINT", "North Point"), ("12 ELM", "12 Elm")])
def test_title_street(spark, raw, title):
    assert spark.createDataFrame([(raw,)], "s string").select(text.title_street(F.col("s")).alias("t")).first().t == title


@pytest.mark.parametrize("name, core", [("Cal Park, Harborview", "cal park"), ("Cal Park Harborview, WA", "cal park"), ("Washington", "washington"), ("Bay - USA", "bay"), ("Harborview", "harborview")])
def test_core(spark, name, core):
    assert spark.createDataFrame([(name,)], "s string").select(text.core(F.col("s"), "harborview").alias("t")).first().t == core


def test_search_words(spark):
    df = spark.createDataFrame([("O'Brien  Street & 5th Avenue",)], "s string")
    assert df.select(text.normalised(F.col("s")).alias("n")).first().n == "obrien st 5th ave"
    score = lambda n, q: df.select(text.match_score(F.lit(n), F.lit(q)).alias("x")).first().x
    assert [score("pike st", q) for q in ("pike st", "pik", "st pike", "ike", "ke", "zoo")] == [0, 1, 2, 3, -1, -1]


def test_share_tokens():
    for fields in (["a", "Übung 5~6_7"], [""], []):
        assert text.read_token(text.share_token("t", fields)) == ("t", fields)
    with pytest.raises(ValueError):
        text.read_token("x~1")


def test_support_counts_longer_names_in_the_box(spark):
    rows = [(1, "Pier", 0.0, 0.0), (2, "Pier Market", 100.0, 0.0), (3, "Old pier cafe", 0.0, 29_000.0), (4, "Pier Market", 31_000.0, 0.0), (5, "pier", 5.0, 5.0), (6, None, 0.0, 0.0), (7, "", 0.0, 0.0)]
    got = {r.place: r.support for r in places.support(spark.createDataFrame(rows, "place long, name string, x double, y double")).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 0, 5: 2, 6: 0, 7: 0}


def test_variants_are_pruned_greedily(spark):
    rows = [
        (1, "Cal Park", "park", 5, 0.9, 0.0, 0.0), (2, "Cal Park, Harborview", "park", 0, 0.9, 400_000.0, 0.0), (3, "Cal Park Cafe", "food", 0, 0.9, 10.0, 0.0),
        (4, "Cal Park North", "park", 0, 0.8, 400_000.0, 0.0), (5, "Cal Park South", "park", 1, 0.8, 400_000.0, 0.0), (6, "Cal", "park", 0, 0.5, 9_000_000.0, 0.0),
    ]
    got = places.prune_variants(spark.createDataFrame(rows, "place long, name string, group string, support long, conf double, x double, y double"), ("harborview",))
    assert sorted(r.place for r in got.collect()) == [1, 3, 5, 6]


def test_addresses_hold_one_point_each(spark):
    rows = [("12 A", "OAK ST", 3.0, 1.0), ("12", "OAK ST", 2.0, 1.0), ("x", "OAK ST", 0.0, 0.0), ("70000", "OAK ST", 0.0, 0.0), ("7", None, 0.0, 0.0), ("7", "ELM", 0.0, 0.0)]
    got = places.addresses(spark.createDataFrame(rows, "number string, street string, x double, y double")).collect()
    assert sorted((r.street, r.street_no, r.number, r.x) for r in got) == [("Elm", 0, 7, 0.0), ("Oak St", 1, 12, 2.0)]


def test_lines_and_bundles_round_trip():
    line = [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    assert packing.encode_line(line) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert np.allclose(packing.decode_line(packing.encode_line(line)), line)
    arrays = {"a": ("u2", np.array([5, 3, 65535, 0]), True), "b": ("i4", np.array([-7, 7]), False), "c": ("f4", np.array([0.5, 1.5]), False), "d": ("u1", np.array([], int), True)}
    packed = packing.bundle(arrays, {"names": ["x", "ü"]})
    back, strings = packing.unbundle(packed)
    assert strings == {"names": ["x", "ü"]} and packing.bundle(arrays, {"names": ["x", "ü"]}) == packed
    assert all(np.array_equal(back[k], v) for k, (_, v, _) in arrays.items())
    with pytest.raises(TypeError):
        packing.bundle({"z": ("q9", np.array([1]), False)}, {})


def test_simplified_keeps_ends_and_corners():
    assert geometry.simplified([(0, 0), (1, 0.01), (2, 0), (2, 5)], 0.1) == [(0, 0), (2, 0), (2, 5)]


def test_projection_of_known_points(spark):
    df = spark.createDataFrame([(-123.0, 0.0), (-122.3328, 47.6061)], "lon double, lat double")
    x, y = geometry.transverse_mercator(F.col("lon"), F.col("lat"))
    a, b = df.select(x.alias("x"), y.alias("y")).collect()
    assert (a.x, a.y) == pytest.approx((500_000.0, 0.0), abs=1e-6)
    assert b.x == pytest.approx(550_150, abs=200) and b.y == pytest.approx(5_272_700, abs=600)


def test_layout_and_spline():
    rng = np.random.default_rng(5)
    true = rng.random((25, 2)) * 10
    wanted = np.sqrt(((true[:, None] - true[None]) ** 2).sum(-1))
    moved, stress = warp.smacof(wanted, true + rng.normal(0, 0.5, true.shape), 300, 1e-12)
    assert stress < 0.02
    turned = true @ np.array([[0, -1], [1, 0]]) * 2 + 5
    assert np.allclose(warp.procrustes(turned, true), true)
    shifted = true + [1.0, 2.0]
    assert np.allclose(warp.bent(true, true, warp.spline(true, shifted, 0.0)), shifted, atol=1e-6)


def test_files(spark, tmp_path):
    (tmp_path / "lines.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"category": "BKF-BL", "street": "A"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2]]]}}, {"type": "Feature", "properties": {"category": "X", "street": null}, "geometry": {"type": "LineString", "coordinates": [[5, 5], [6, 7]]}}, {"type": "Feature", "properties": {}, "geometry": null}]}')
    got = files.geojson_lines(spark, str(tmp_path / "lines.geojson")).collect()
    assert sorted((r.category, len(r.line), r.line[0].x) for r in got) == [("BKF-BL", 2, 0.0), ("X", 2, 5.0)]
    (tmp_path / "hoods.geojson").write_text('{"features": [{"properties": {"name": "H"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}}]}')
    hood = files.geojson_polygons(spark, str(tmp_path / "hoods.geojson"), "name string").first()
    assert hood.name == "H" and hood.area == 15.0 and len(hood.rings) == 2
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 2.0)], None)], "id long, line array<struct<x: double, y: double>>, name string")
    files.write_geojson(rows, str(tmp_path / "out"), "line")
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back.geometry.coordinates == [[0.0, 0.0], [1.0, 2.0]] and back.properties.id == 1
    files.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "name"]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for force, n in ((False, 1), (False, 1), (True, 2)):
        assert files.cached(spark, str(tmp_path / "kept"), make, force).count() == 3 and len(calls) == n


def test_bbox_scan_reaches_the_reader(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "named_struct('xmin', double(id), 'xmax', double(id + 1), 'ymin', 0D, 'ymax', 1D) as bbox", "id * 2 as other")
    files.write_parquet(rows, str(tmp_path / "t"))
    got = files.bbox_scan(spark, str(tmp_path / "t"), (10, 0, 12, 1), ("id",))
    assert sorted(r.id for r in got.collect()) == [9, 10, 11, 12]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(bbox.xmax)" in plan.replace("`", "") and "other" not in plan


def test_sidewalks(spark):
    line = "edge_id long, x0 double, y0 double, x1 double, y1 double"
    streets = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0), (2, 0.0, 0.0, 0.0, 100.0)], line)
    candidates = spark.createDataFrame([(11, 0.0, 8.0, 100.0, 8.0), (12, 50.0, 20.0, 50.0, 90.0), (13, 5.0, 2.0, 5.0, 11.0)], line)
    got = {r.edge_id: (r.near, r.parallel) for r in sidewalks.probe_hits(candidates, streets).collect()}
    assert got[11] == (5, 5) and got[12] == (0, 0) and got[13][0] == 5
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 3, 4), (5, 4, 5)], "edge_id long, u long, v long")
    kept = sidewalks.prune_stubs(edges, spark.createDataFrame([(4,), (5,)], "edge_id long"))
    assert sorted(r.edge_id for r in kept.collect()) == [1, 2, 3]
    joined = sidewalks.reconnect(spark.createDataFrame([(1, 1, 2, 5), (2, 8, 9, 5)], "edge_id long, u long, v long, len long"), spark.createDataFrame([(10, 2, 3, 4), (11, 3, 8, 4), (12, 1, 9, 99), (13, 3, 4, 1)], "edge_id long, u long, v long, len long"))
    assert sorted(r.edge_id for r in joined.collect()) == [10, 11]


def test_numbers_follow_the_order_over_many_ranges(spark):
    rows = spark.createDataFrame([(f"{i * 7919 % 1000:04d}",) for i in range(1500)] + [("",), (None,)], "name string")
    got = {r["name"]: r.number for r in packing.dictionary(rows, "name").collect()}
    assert got == {f"{i:04d}": i + 1 for i in range(1000)}
    assert packing.dictionary(rows.limit(0), "name").collect() == []
