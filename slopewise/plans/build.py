"""Queries over the build of the network: from raw pieces and stations to climb-attributed arcs, and what is left of smaller steps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopewise.config import Settings
from slopewise.functions import geometry, text
from slopewise.operators import access, corridors, elevation, paths, raster, runs, sidewalks, spatial, topology
from slopewise.operators.costs import OBJECTIVES, arc_cost
from slopewise.plans import heights, routing, streets
from slopewise.plans.registry import query
from slopewise.plans.streets import _FACTS
from slopewise.session import cut
from slopewise.sources import street_network as net

def stations(spark: SparkSession, sf_dir: str, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(edge_id, i, dist, z): heights in metres off the smoothed raster of corners, along each edge; null at the raster's rim."""
    place = net.nodes(spark, sf_dir).select(F.col("node").alias("u"), "col", "row")
    at = geometry.densify(F.col("len") / 100, settings.sample_spacing, settings.least_samples)
    rows = edges.join(place, "u").select("edge_id", "len", "col", "row", F.col("segment").startswith("r").alias("right"), F.posexplode(at).alias("i", "dist")).withColumn("f", F.col("dist") * 100 / F.col("len"))
    spots = rows.select(F.struct("edge_id", "i").alias("spot"), (F.col("col") + F.when(F.col("right"), F.col("f")).otherwise(0.0) + 0.5).alias("px"), (F.col("row") + F.when(F.col("right"), 0.0).otherwise(F.col("f")) + 0.5).alias("py"))
    cells, sigma = heights._cells(spark, sf_dir), settings.dem_sigma * 100 / net.CELL
    cells = raster.smooth(cells, sigma) if sigma > 0 else cells
    z = raster.sample(spots, cells, "spot").select("spot.*", (F.col("z") / 100).alias("z"))
    return rows.select("edge_id", "i", "dist").join(z, ["edge_id", "i"], "left")


def built(spark: SparkSession, sf_dir: str, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(edge_id, dist, z): rectified profiles of the edges."""
    edges = cut(edges)
    on_raster = net.nodes(spark, sf_dir).select("node", (F.col("z") / 100).alias("z"))
    known = elevation.node_heights(edges.select("u", "v", "len", "is_structure"), on_raster)
    profile = cut(elevation.build(edges, cut(stations(spark, sf_dir, edges, settings)), known, settings.sample_spacing, settings.smooth_window))
    return cut(elevation.rectify(edges, profile, settings.deadband))


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.edges(spark, sf_dir).where(f"edge_id < {net.PARALLEL}")


@query("built_climbs")
def built_climbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, gain, loss, net) of all streets, through the whole build."""
    return elevation.climbs(built(spark, sf_dir, _single(spark, sf_dir)))


@query("built_metrics")
def built_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of every street in both directions, of its rectified profile."""
    return elevation.directed(built(spark, sf_dir, _single(spark, sf_dir)), tuple(k / 100 for k in net.GRADES))


def built_arcs(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Arcs of the streets that base_filter keeps and whose class lets one walk, with gain and grades of their built profiles, in centimetres.

    The rules of the fixture close so many streets that the rest would not hang together; they are left to the queries on access.
    """
    raw = streets.segments(spark, sf_dir).where(f"edge_id < {net.PARALLEL}")
    open_ = access.base_filter(raw).where(access.class_open(F.col("class"), "walk"))
    edges = runs.drop_slivers(_single(spark, sf_dir).join(open_.select("edge_id"), "edge_id", "left_semi"), 50)
    rows = elevation.directed(built(spark, sf_dir, edges, settings), tuple(k / 100 for k in net.GRADES))
    ways = edges.select("edge_id", "len", "cls", "name", F.inline(F.array(F.struct(F.lit("fwd").alias("direction"), F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.lit("rev").alias("direction"), F.col("v").alias("src"), F.col("u").alias("dst")))))
    centimetres = [(F.col(c) * 100).alias(c) for c in ("gain", "loss", *[f"above_{k}" for k in net.GRADES])]
    measured = rows.select(F.col("profile").alias("edge_id"), "direction", "max_grade", *centimetres).withColumnsRenamed({f"above_{k}": f"d_above_{k}" for k in net.GRADES})
    return ways.join(measured, ["edge_id", "direction"]).withColumn("arc_id", F.col("edge_id") * 2 + F.when(F.col("direction") == "fwd", 0).otherwise(1))


@dataclass(frozen=True)
class Analysis:
    """What a run of the whole analysis leaves: arcs of the largest component, compared trips, and corridors."""

    arcs: DataFrame
    trips: DataFrame
    corridors: DataFrame


def analyse(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> Analysis:
    """The whole way from raw pieces to corridors: filter, access, slivers, profiles, arcs, routes of all pairs in the largest component, usage, scores, corridors."""
    arcs = cut(built_arcs(spark, sf_dir, settings))
    inside = cut(topology.largest_strong_component(arcs.select("src", "dst", "arc_id")))
    arcs = cut(arcs.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    costed = arcs.select("src", "dst", "arc_id", *[(arc_cost(o, "walk") + F.expr(routing.TIE)).alias(o.name) for o in OBJECTIVES])
    asked = routing._requests(spark, sf_dir, rank=settings.point_rank)
    steps = cut(paths.steps(paths.routes(costed, asked, tuple(o.name for o in OBJECTIVES))).join(arcs.select("arc_id", "edge_id", "len", "gain", F.col("max_grade").alias("grade")), "arc_id"))
    trips = steps.groupBy("objective", "request").agg(F.sum("len").alias("distance"), F.sum("gain").alias("gain"), F.max("grade").alias("max_grade"))
    trips = cut(paths.comparisons(trips.withColumns({"mode": F.lit("walk"), "origin": F.expr("request div 1000"), "destination": F.col("request") % 1000})))
    usage = cut(corridors.usage(steps.where("objective <> 'shortest'").select("request", "objective", "edge_id"), trips.select("request", "objective", "origin", "destination", "saved", "efficiency")))
    place = net.nodes(spark, sf_dir).select("node", "x", "y")
    edges = net.edges(spark, sf_dir).join(place.selectExpr("node as u", "x as x0", "y as y0"), "u").join(place.selectExpr("node as v", "x as x1", "y as y1"), "v").withColumn("low_stress", access.low_stress(F.col("cls"), access.bike_facility(F.col("cls"), F.col("bike_ok"))))
    scored = cut(corridors.scores(usage, edges).join(usage.drop("efficiency"), "edge_id"))
    return Analysis(arcs, trips, corridors.corridors(scored, edges, settings.corridor_quantile, least=settings.corridor_length * 100))


@query("built_corridors")
def built_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corridors of the whole analysis."""
    return analyse(spark, sf_dir).corridors.select("rank", "corridor", "names", "n", "length", "total_score", "n_pieces")


@query("sliver_drop", "SELECT edge_id, len FROM edge WHERE len - 8000 > 2000")
def sliver_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces longer than the least length; here what they have beyond 80 m counts."""
    return runs.drop_slivers(net.edges(spark, sf_dir).select("edge_id", (F.col("len") - 8000).alias("len")), 2000).select("edge_id", (F.col("len") + 8000).alias("len"))


@query(
    "node_positions",
    """SELECT node, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM (
        SELECT u AS node, x + edge_id % 5 AS x, y - edge_id % 3 AS y FROM edge JOIN node ON node = u UNION ALL SELECT v, x - edge_id % 7, y FROM edge JOIN node ON node = v) GROUP BY node""",
)
def node_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ends of streets at a node lie on the mean; they are off by some centimetres."""
    place, e = net.nodes(spark, sf_dir).select("node", "x", "y"), F.col("edge_id")
    at = lambda end, dx, dy: net.edges(spark, sf_dir).select(e, F.col(end).alias("node")).join(place, "node").select("node", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ends = at("u", e % 5, -(e % 3)).unionByName(at("v", -(e % 7), F.lit(0)))
    return elevation.node_positions(ends).select("node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("list_overlap", "WITH l AS (SELECT segment, coalesce(list(DISTINCT name) FILTER (WHERE walk_ok), []) AS a, coalesce(list(DISTINCT name) FILTER (WHERE bike_ok), []) AS b FROM edge GROUP BY segment) SELECT segment, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 100 ELSE 100.0::DOUBLE * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM l")
def list_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the names are that one passes on each street on foot and by bicycle."""
    sets = net.edges(spark, sf_dir).groupBy("segment").agg(F.collect_set(F.when(F.col("walk_ok"), F.col("name"))).alias("a"), F.collect_set(F.when(F.col("bike_ok"), F.col("name"))).alias("b"))
    return sets.select("segment", F.round(corridors.plain_overlap(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("upper_median", "SELECT name, list_sort(list(abs(z_v - z_u)))[count(*) // 2 + 1] AS median FROM edge GROUP BY name")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median climb of a street's pieces; of two in the middle the larger, as loops are judged."""
    return paths.upper_median(net.edges(spark, sf_dir).select("name", F.abs(F.col("z_v") - F.col("z_u")).alias("climb")), "name", "climb").withColumnRenamed("climb", "median")


@query(
    "access_points_by_rank",
    f"""WITH {_FACTS}, ranked AS (SELECT hood, node, row_number() OVER (PARTITION BY hood ORDER BY tier, round(pow(x - cx, 2) + pow(y - cy, 2), 3), node) AS r, count(*) OVER (PARTITION BY hood) AS n FROM placed JOIN centre USING (hood))
        SELECT hood, t.rank, node FROM ranked, (VALUES (0), (1), (2)) AS t(rank) WHERE r = least(t.rank + 1, n)""",
)
def access_points_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node that stands for each neighbourhood, and its second and third choice."""
    each = [streets.access_points(spark, sf_dir, rank).select("hood", F.lit(rank).alias("rank"), "node") for rank in range(3)]
    return reduce(DataFrame.unionByName, each)


def top(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group in an order, numbered from 1 as rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most)


@query("top_streets", "SELECT mode, name, len, rank FROM (SELECT mode, name, CAST(sum(len) AS BIGINT) AS len, row_number() OVER (PARTITION BY mode ORDER BY sum(len) DESC, name) AS rank FROM (SELECT 'walk' AS mode, name, len FROM edge WHERE walk_ok UNION ALL SELECT 'bike', name, len FROM edge WHERE bike_ok) GROUP BY mode, name) WHERE rank <= 22")
def top_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 22 longest names of each mode."""
    edges = net.edges(spark, sf_dir)
    rows = edges.where("walk_ok").select(F.lit("walk").alias("mode"), "name", "len").unionByName(edges.where("bike_ok").select(F.lit("bike").alias("mode"), "name", "len"))
    return top(rows.groupBy("mode", "name").agg(F.sum("len").alias("len")), ["mode"], [F.desc("len"), F.col("name")], 22)


@query("units", "SELECT edge_id, round(abs(z_v - z_u) / 100.0::DOUBLE * 3.28084::DOUBLE, 6) AS feet, round(len / 100.0::DOUBLE / 1609.344::DOUBLE, 9) AS miles FROM edge")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.edges(spark, sf_dir).select("edge_id", F.round(text.feet(F.abs(F.col("z_v") - F.col("z_u")) / 100), 6).alias("feet"), F.round(text.miles(F.col("len") / 100), 9).alias("miles"))


@query(
    "human_bytes",
    """SELECT p_partkey AS part, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824)
              ELSE printf('%.1f TB', n / 1099511627776) END AS size FROM (SELECT p_partkey, pow(2, p_partkey % 41)::DOUBLE AS n FROM part)""",
)
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), text.human_bytes(F.pow(F.lit(2.0), F.col("p_partkey") % 41)).alias("size"))


@query("lead_streets", "WITH r AS (SELECT segment, name, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, name) AS r FROM edge WHERE trim(name) <> '' GROUP BY segment, name) SELECT array_to_string(list_sort(list(DISTINCT name)), '; ') AS leads FROM r WHERE r = 1")
def lead_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = corridors.canonical_names(net.edges(spark, sf_dir).select("segment", "name"), "segment").agg(F.collect_set("names").alias("names"))
    return names.select(F.array_join(F.array_sort(text.lead_streets(F.col("names"))), "; ").alias("leads"))


@query("edge_boxes", "SELECT edge_id, least(a.x, b.x) AS x0, least(a.y, b.y) AS y0, greatest(a.x, b.x) AS x1, greatest(a.y, b.y) AS y1, edge_id % 29 = 0 AS structure, cls FROM edge e JOIN node a ON a.node = e.u JOIN node b ON b.node = e.v")
def edge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each edge and its attributes, as a map looks them up."""
    rows = streets._straight(spark, sf_dir).join(net.edges(spark, sf_dir).select("edge_id", "is_structure"), "edge_id")
    low, high = (lambda c: F.least(f"{c}0", f"{c}1").cast("long")), (lambda c: F.greatest(f"{c}0", f"{c}1").cast("long"))
    return rows.select("edge_id", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"), F.col("is_structure").alias("structure"), "cls")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hood, ring): a diamond in the box of each neighbourhood, with a point that repeats and left open, as files have them."""
    h, x, y = net.hoods(spark, sf_dir), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return h.select("hood", F.array(point(x, F.col("y0")), point(F.col("x1"), y), point(F.col("x1"), y), point(x, F.col("y1")), point(F.col("x0"), y)).alias("ring"))


_DIAMOND = "abs(2 * {x} - x0 - x1) * (y1 - y0) + abs(2 * {y} - y0 - y1) * (x1 - x0) < (x1 - x0) * (y1 - y0)"


@query("polygon_label", f"WITH p AS (SELECT node, x + 137 AS x, y + 411 AS y FROM node) SELECT p.node, min(h.hood) AS hood FROM p LEFT JOIN hood h ON {_DIAMOND.format(x='p.x', y='p.y')} GROUP BY p.node")
def polygon_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diamond that each corner lies in, a little moved so that none lies on an edge."""
    points = net.nodes(spark, sf_dir).select("node", (F.col("x") + 137).alias("x"), (F.col("y") + 411).alias("y"))
    rings = polygons(spark, sf_dir).withColumn("ring", geometry.repaired(F.col("ring")))
    return spatial.label_polygons(points, rings, "node", "hood", net.CELL * 4)


@query("polygon_measures", "SELECT hood, (x1 - x0) * (y1 - y0) / 2.0::DOUBLE AS area, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy, (x0 + x1) / 2.0::DOUBLE AS px, (y0 + y1) / 2.0::DOUBLE AS py FROM hood")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, centre of mass and a point inside of each diamond."""
    ring = geometry.repaired(F.col("ring"))
    rows = polygons(spark, sf_dir).select("hood", ring.alias("ring"))
    rows = rows.select("hood", geometry.area(F.col("ring")).alias("area"), geometry.centroid(F.col("ring")).alias("c"), geometry.representative(F.col("ring")).alias("p"))
    return rows.select("hood", F.round("area", 3).alias("area"), F.round("c.x", 3).alias("cx"), F.round("c.y", 3).alias("cy"), F.round("p.x", 3).alias("px"), F.round("p.y", 3).alias("py"))


@query(
    "city_boundary",
    f"""WITH p AS (SELECT visitor, x - 50000 AS x, y - 50000 AS y FROM (SELECT c_custkey AS visitor, c_custkey * 7919 % (w * {net.CELL} + 100000) AS x, c_custkey * 104729 % (w * {net.CELL} + 100000) AS y FROM customer, w)),
            d AS (SELECT visitor, h.hood, pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2) AS d2 FROM p, hood h)
       SELECT visitor, bool_or(d2 <= 625000000) AS inside FROM d GROUP BY visitor""",
)
def city_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each visitor, some of whom are outside, is in a neighbourhood or within 250 m of one."""
    w, key = net.width(spark, sf_dir) * net.CELL + 100_000, F.col("c_custkey")
    points = net.table(spark, sf_dir, "customer").select(key.alias("visitor"), (key * 7919 % w - 50_000).alias("x"), (key * 104729 % w - 50_000).alias("y"))
    corner = lambda a, b: F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    rings = net.hoods(spark, sf_dir).select("hood", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")).alias("ring"))
    return spatial.within_reach(points, rings, "visitor", 25_000)


@query(
    "sidewalk_shortcuts",
    """WITH stay AS MATERIALIZED (SELECT u, v, len FROM edge WHERE cls <> 'footway'), link AS MATERIALIZED (SELECT u AS s, v AS t, len FROM stay UNION ALL SELECT v, u, len FROM stay),
            live AS (SELECT DISTINCT s AS node FROM link), beside AS (SELECT edge_id, u, v, len, 3.0::DOUBLE * len + 2500 AS most FROM edge WHERE cls = 'footway' AND edge_id < 1000000000),
            one AS (SELECT edge_id, t AS stop, w.len AS total, most, v FROM beside JOIN link w ON w.s = beside.u WHERE w.len <= most),
            two AS (SELECT edge_id, t AS stop, total + w.len AS total, most, v FROM one JOIN link w ON w.s = one.stop WHERE total + w.len <= most),
            three AS (SELECT edge_id, t AS stop, total + w.len AS total, most, v FROM two JOIN link w ON w.s = two.stop WHERE total + w.len <= most),
            four AS (SELECT edge_id, t AS stop, total + w.len AS total, most, v FROM three JOIN link w ON w.s = three.stop WHERE total + w.len <= most),
            held AS (SELECT edge_id FROM one WHERE stop = v UNION SELECT edge_id FROM two WHERE stop = v UNION SELECT edge_id FROM three WHERE stop = v UNION SELECT edge_id FROM four WHERE stop = v)
       SELECT edge_id FROM beside WHERE edge_id NOT IN (FROM held) OR u NOT IN (FROM live) OR v NOT IN (FROM live)""",
)
def sidewalk_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footways, but for parallel ones, that the other streets have no way round for, of three times their length at most; that is four edges."""
    rows = streets._straight(spark, sf_dir)
    corners = net.nodes(spark, sf_dir).select("node", "x", "y")
    return sidewalks.shortcuts(rows.where("cls <> 'footway'").select("u", "v", "len"), rows.where(f"cls = 'footway' and edge_id < {net.PARALLEL}"), corners, 3.0, 2500.0, 3000.0)
