"""Further queries: routes in detail, windows of the map, layers of a report."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopewise.functions import geometry
from slopewise.operators import access, corridors, costs, packing, profiles, spatial
from slopewise.plans import heights, routing, terrain
from slopewise.plans.registry import query
from slopewise.sources import files
from slopewise.sources import street_network as net


@query(
    "directional_metrics",
    """WITH leg AS (SELECT profile, 5 AS dd, z / 100.0::DOUBLE - lag(z / 100.0::DOUBLE) OVER (PARTITION BY profile ORDER BY station) AS dz FROM profile),
            way AS (SELECT profile, 'fwd' AS direction, dd, dz, greatest(-0.6::DOUBLE, least(0.6::DOUBLE, dz / dd)) AS g FROM leg WHERE dz IS NOT NULL
                    UNION ALL SELECT profile, 'rev', dd, -dz, -greatest(-0.6::DOUBLE, least(0.6::DOUBLE, dz / dd)) FROM leg WHERE dz IS NOT NULL),
            c AS (SELECT *, sum(dd) OVER (PARTITION BY profile, direction ORDER BY g) AS upto, sum(dd) OVER (PARTITION BY profile, direction) * 0.95::DOUBLE AS goal FROM way)
       SELECT profile, direction, round(sum(greatest(dz, 0)), 4) AS gain, round(sum(greatest(-dz, 0)), 4) AS loss, round(max(g), 6) AS max_grade, round(min(g) FILTER (WHERE upto >= goal), 6) AS p95_grade,
              round(sum(abs(g) * dd) / sum(dd), 6) AS mean_abs_grade FROM c GROUP BY profile, direction""",
)
def directional_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.directional(heights._intervals(spark, sf_dir), tuple(k / 100 for k in net.GRADES))
    return rows.select("profile", "direction", F.round("gain", 4).alias("gain"), F.round("loss", 4).alias("loss"), *[F.round(c, 6).alias(c) for c in ("max_grade", "p95_grade", "mean_abs_grade")])


@query(
    "resampled_profile",
    """WITH n AS (SELECT profile, max(dist) AS far, count(*) AS k FROM profile GROUP BY profile HAVING count(*) > 1), s AS (SELECT profile, i, far * i / 32.0::DOUBLE AS d FROM n, unnest(range(33)) AS t(i)),
            a AS (SELECT s.profile, i, d, least(CAST(floor(d / 5) AS BIGINT), k - 2) AS st FROM s JOIN n USING (profile))
       SELECT a.profile, i AS sample, round(p.z + (q.z - p.z) * (d - p.dist) / 5, 4) AS z FROM a JOIN profile p ON p.profile = a.profile AND p.station = st JOIN profile q ON q.profile = a.profile AND q.station = st + 1""",
)
def resampled_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = net.profiles(spark, sf_dir).groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("station", "dist", "z"))).alias("s")).where(F.size("s") > 1)
    # Both arrays are columns that are used several times, so they are not taken apart anew for every sample.
    rows = rows.select("profile", F.col("s.dist").alias("d"), F.col("s.z").cast("array<double>").alias("z"))
    return rows.select("profile", F.posexplode(profiles.resampled(F.col("d"), F.col("z"), 33)).alias("sample", "z")).select("profile", "sample", F.round("z", 4).alias("z"))


def _shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.trips(spark, sf_dir, objectives=(costs.SHORTEST,)).join(routing._measured(spark, sf_dir), "arc_id")


_SHORTEST = routing.routes_sql((costs.SHORTEST,))


@query("route_geometry", f"WITH {_SHORTEST} SELECT request, CAST(arg_min(src, pos) AS VARCHAR) || ',' || string_agg(CAST(dst AS VARCHAR), ',' ORDER BY pos) AS corners FROM step JOIN arc USING (arc_id) GROUP BY request")
def route_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of each route, in order."""
    rows = _shortest(spark, sf_dir).groupBy("request").agg(F.min_by("src", "pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("s"))
    return rows.select("request", F.concat_ws(",", F.col("first").cast("string"), F.transform("s", lambda x: x["dst"].cast("string"))).alias("corners"))


@query("route_profile", f"WITH {_SHORTEST} SELECT request, pos, CAST(sum(len) OVER (PARTITION BY request ORDER BY pos) AS BIGINT) AS dist, CASE direction WHEN 'fwd' THEN z_v ELSE z_u END AS z FROM step JOIN arc USING (arc_id)")
def route_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and height at the end of each street of a route."""
    return _shortest(spark, sf_dir).select("request", "pos", F.sum("len").over(W.partitionBy("request").orderBy("pos")).alias("dist"), F.col("z_to").alias("z"))


@query("point_along_route", f"WITH {_SHORTEST}, s AS (SELECT request, pos, dst, sum(len) OVER (PARTITION BY request ORDER BY pos) AS upto, sum(len) OVER (PARTITION BY request) AS whole FROM step JOIN arc USING (arc_id)) SELECT request, arg_min(dst, pos) AS corner FROM s WHERE upto * 2 >= whole GROUP BY request")
def point_along_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first corner at or after half of each route."""
    rows = _shortest(spark, sf_dir).withColumn("upto", F.sum("len").over(W.partitionBy("request").orderBy("pos"))).withColumn("whole", F.sum("len").over(W.partitionBy("request")))
    return rows.where("upto * 2 >= whole").groupBy("request").agg(F.min_by("dst", "pos").alias("corner"))


@query(
    "page_summary",
    f"""WITH {_SHORTEST} SELECT request, round(max(CASE WHEN len < 8500 THEN greatest(0, (gain - loss) / len) ELSE gain / len END), 8) AS steepest,
               round(sum(len * CASE cls WHEN 'residential' THEN 1.0 WHEN 'primary' THEN 1.6 WHEN 'secondary' THEN 1.4 WHEN 'footway' THEN 1.3 WHEN 'cycleway' THEN 0.8 ELSE 1.1 END::DOUBLE), 3) AS stress FROM step JOIN arc USING (arc_id) GROUP BY request""",
)
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steepest street, short ones by their net rise, and length weighted with stress."""
    grade = F.when(F.col("len") < 8500, F.greatest(F.lit(0), (F.col("gain") - F.col("loss")) / F.col("len"))).otherwise(F.col("gain") / F.col("len"))
    rows = _shortest(spark, sf_dir).withColumn("grade", grade).withColumn("weight", access.bike_stress(F.col("cls"), F.lit("")))
    return rows.groupBy("request").agg(F.round(F.max("grade"), 8).alias("steepest"), F.round(F.sum(F.col("len") * F.col("weight")), 3).alias("stress"))


@query("path_cost", f"WITH {_SHORTEST} SELECT request, round(sum({costs.cost_sql(costs.BALANCED, 'walk')}), 3) AS cost FROM step JOIN arc USING (arc_id) GROUP BY request")
def path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shortest routes cost under another objective."""
    costed = costs.costed(net.arcs(spark, sf_dir), "walk", costs.BALANCED).select("arc_id", "cost")
    return routing.trips(spark, sf_dir, objectives=(costs.SHORTEST,)).join(costed, "arc_id").groupBy("request").agg(F.round(F.sum("cost"), 3).alias("cost"))


@query("loop_corners", "SELECT src AS node FROM arc WHERE walk GROUP BY src HAVING count(DISTINCT dst) >= 3 AND bool_or(cls IN ('residential', 'primary', 'secondary'))")
def loop_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners a loop may turn at: three neighbours or more, and a street among them."""
    rows = net.arcs(spark, sf_dir).where("walk").groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n"), F.max(F.col("cls").isin("residential", "primary", "secondary")).alias("street"))
    return rows.where("n >= 3 and street").select("node")


@query(
    "anchors",
    f"""WITH l AS (SELECT i * {5 * net.CELL} + 2500 AS x, j * {5 * net.CELL} + 2500 AS y, i * 10000 + j AS anchor FROM w, unnest(range(0, w // 5 + 1)) AS a(i), unnest(range(0, w // 5 + 1)) AS b(j)),
            d AS (SELECT anchor, node, pow(l.x - n.x, 2) + pow(l.y - n.y, 2) AS d2 FROM l JOIN node n ON abs(l.x - n.x) <= {3 * net.CELL} AND abs(l.y - n.y) <= {3 * net.CELL})
       SELECT anchor, node FROM d WHERE d2 <= pow({3 * net.CELL}, 2) QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY d2, node) = 1""",
)
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice of every fifth corner or so, snapped to the nearest corner within 0.6 of its spacing."""
    n, step = net.width(spark, sf_dir) // 5 + 1, 5 * net.CELL
    lattice = spark.range(n * n).select((F.expr(f"id div {n}") * 10_000 + F.col("id") % n).alias("anchor"), (F.expr(f"id div {n}") * step + 2500).alias("x"), (F.col("id") % n * step + 2500).alias("y"))
    return spatial.nearest(lattice, net.nodes(spark, sf_dir), "anchor", "node", 0.6 * step).select("anchor", "node")


@query("edges_in_window", f"SELECT edge_id FROM edge JOIN node a ON a.node = u JOIN node b ON b.node = v WHERE least(a.x, b.x) <= {9 * net.CELL} AND greatest(a.x, b.x) >= {3 * net.CELL} AND least(a.y, b.y) <= {8 * net.CELL} AND greatest(a.y, b.y) >= {2 * net.CELL}")
def edges_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch a box of the map."""
    place = net.nodes(spark, sf_dir)
    rows = net.edges(spark, sf_dir).select("edge_id", "u", "v").join(place.selectExpr("node as u", "x as ax", "y as ay"), "u").join(place.selectExpr("node as v", "x as bx", "y as by"), "v")
    meets = lambda a, b, low, high: (F.least(a, b) <= high * net.CELL) & (F.greatest(a, b) >= low * net.CELL)
    return rows.where(meets("ax", "bx", 3, 9) & meets("ay", "by", 2, 8)).select("edge_id")


@query(
    "inspect_edge",
    "WITH m AS (SELECT edge_id, a.x + b.x AS x2, a.y + b.y AS y2 FROM edge JOIN node a ON a.node = u JOIN node b ON b.node = v), p AS (SELECT max(x) AS px, max(y) AS py FROM node) SELECT edge_id FROM m, p ORDER BY (x2 - px) * (x2 - px) + (y2 - py) * (y2 - py), edge_id LIMIT 1",
)
def inspect_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge whose middle is nearest to the middle of the map."""
    place = net.nodes(spark, sf_dir)
    spot = place.agg(F.max("x").alias("px"), F.max("y").alias("py"))
    rows = net.edges(spark, sf_dir).select("edge_id", "u", "v").join(place.selectExpr("node as u", "x as ax", "y as ay"), "u").join(place.selectExpr("node as v", "x as bx", "y as by"), "v").join(F.broadcast(spot))
    far = (F.col("ax") + F.col("bx") - F.col("px")) ** 2 + (F.col("ay") + F.col("by") - F.col("py")) ** 2
    return rows.agg(F.min(F.struct(far.alias("d"), "edge_id")).alias("m")).select("m.edge_id")


@query("top_barriers", f"WITH {terrain._BARRIERS} SELECT * FROM barrier ORDER BY score DESC, edge_id LIMIT 400")
def top_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400 barriers with the highest score."""
    return terrain.barriers(spark, sf_dir).orderBy(F.desc("score"), "edge_id").limit(400)


@query("corridor_material", f"WITH {terrain._SCORES}, c AS (SELECT quantile_cont(score, 0.93) AS cut FROM score WHERE score > 0) SELECT edge_id, len FROM score JOIN edge USING (edge_id), c WHERE score >= cut AND score > 0")
def corridor_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose score reaches the corridors' cut."""
    scores = terrain.edge_scores(spark, sf_dir)
    level = scores.where("score > 0").agg(F.percentile("score", F.lit(corridors.QUANTILE)).alias("cut"))
    best = scores.join(F.broadcast(level)).where("score >= cut and score > 0").select("edge_id")
    return net.edges(spark, sf_dir).select("edge_id", "len").join(best, "edge_id", "left_semi")


@query("simplified_lines")
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points of each profile are left within a metre of its line."""
    rows = net.profiles(spark, sf_dir).groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("station", F.col("dist").cast("double").alias("x"), (F.col("z") / 100).alias("y")))).alias("p"))

    @F.pandas_udf("int")
    def left(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(geometry.simplified(list(zip(a, b, strict=True)), 1.0)) for a, b in zip(x, y, strict=True)])

    return rows.select("profile", F.size("p").alias("points"), left("p.x", "p.y").alias("kept"))


@query(
    "packed_network",
    """WITH c AS (SELECT (SELECT count(*) FROM node) AS corners, (SELECT count(*) FROM arc) AS arcs, (SELECT count(*) FROM edge) AS edges)
       SELECT array_name AS "array", CASE kind WHEN 'c' THEN corners WHEN 'f' THEN corners + 1 WHEN 'a' THEN arcs ELSE edges END AS n
       FROM c, (VALUES ('x', 'c'), ('y', 'c'), ('z', 'c'), ('first', 'f'), ('head', 'a'), ('edge', 'a'), ('gain', 'a'), ('flags', 'a'), ('len', 'e'), ('name', 'e'), ('cls', 'e')) AS t(array_name, kind)""",
)
def packed_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrays of the network's bundle and their lengths."""
    path = packing.pack_network(net.nodes(spark, sf_dir), net.edges(spark, sf_dir), net.arcs(spark, sf_dir))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0).to_pylist():
                arrays, _ = packing.read_bundle(one)
                yield pa.RecordBatch.from_arrays([pa.array(sorted(arrays)), pa.array([len(arrays[k]) for k in sorted(arrays)], pa.int64())], ["array", "n"])

    return spark.range(1, numPartitions=1).select(F.lit(path).alias("path")).mapInArrow(lengths, "array string, n long")


@query("sources", "SELECT name, required FROM (VALUES ('segments', true), ('hoods', true), ('raster', true), ('bikeways', false), ('places', false), ('addresses', false), ('features', false)) AS t(name, required)", network=False)
def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.datasets(spark).select("name", "required")
