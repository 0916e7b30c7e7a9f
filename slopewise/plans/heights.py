"""Queries over elevation profiles and rasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.operators import profiles, raster
from slopewise.plans.registry import query
from slopewise.sources import street_network as net

_STEPS = "leg AS (SELECT profile, station, 5 AS dd, (z - lag(z) OVER (PARTITION BY profile ORDER BY station)) / 100.0::DOUBLE AS dz FROM profile QUALIFY station > 0), grade AS (SELECT *, greatest(-0.6::DOUBLE, least(0.6::DOUBLE, dz / dd)) AS grade FROM leg)"


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = net.profiles(spark, sf_dir).withColumn("z", F.col("z") / 100)
    return profiles.intervals(rows)


@query("interval_grades", "WITH leg AS (SELECT profile, station, 5 AS dd, z / 100.0::DOUBLE - lag(z / 100.0::DOUBLE) OVER (PARTITION BY profile ORDER BY station) AS dz FROM profile) SELECT profile, station, round(greatest(-0.6::DOUBLE, least(0.6::DOUBLE, dz / dd)), 6) AS grade FROM leg WHERE dz IS NOT NULL")
def interval_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir).select("profile", "station", F.round("grade", 6).alias("grade"))


@query(
    "distance_above",
    "WITH leg AS (SELECT profile, z - lag(z) OVER (PARTITION BY profile ORDER BY station) AS dz FROM profile) SELECT profile, " + ", ".join(f"CAST(sum(CASE WHEN least(300, dz) >= {k * 5} THEN 5 ELSE 0 END) AS BIGINT) AS above_{k}" for k in net.GRADES) + " FROM leg WHERE dz IS NOT NULL GROUP BY profile",
)
def distance_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    cm = profiles.intervals(net.profiles(spark, sf_dir).withColumn("dist", F.col("dist") * 100))
    return profiles.distance_above(cm.withColumn("grade", F.greatest(F.lit(-0.6), F.least(F.lit(0.6), F.col("dz") / F.col("dd")))).withColumn("dd", F.expr("dd div 100")), tuple(k / 100 for k in net.GRADES))


@query(
    "weighted_p95",
    """WITH a AS (SELECT name, abs(z_v - z_u) AS rise, len, sum(len) OVER (PARTITION BY name ORDER BY abs(z_v - z_u)) AS upto, sum(len) OVER (PARTITION BY name) * 0.95::DOUBLE AS goal FROM edge)
       SELECT name, min(rise) AS p95 FROM a WHERE upto >= goal GROUP BY name""",
)
def weighted_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = net.edges(spark, sf_dir).select("name", F.abs(F.col("z_v") - F.col("z_u")).alias("rise"), "len")
    return profiles.weighted_percentile(rows, "name", "rise", "len", 95, "p95")


@query("gain_loss_raw", "WITH leg AS (SELECT profile, z - lag(z) OVER (PARTITION BY profile ORDER BY station) AS dz FROM profile) SELECT profile, CAST(sum(greatest(dz, 0)) AS BIGINT) AS gain, CAST(sum(greatest(-dz, 0)) AS BIGINT) AS loss FROM leg WHERE dz IS NOT NULL GROUP BY profile")
def gain_loss_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.gain_loss(profiles.intervals(net.profiles(spark, sf_dir)))
    return rows.select("profile", F.col("gain").cast("long").alias("gain"), F.col("loss").cast("long").alias("loss"))


@query(
    "running_envelope",
    """WITH e AS (SELECT *, first_value(z) OVER w AS a, last_value(z) OVER w AS b, max(z) OVER u AS hi, min(z) OVER u AS lo FROM profile
                  WINDOW w AS (PARTITION BY profile ORDER BY station ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), u AS (PARTITION BY profile ORDER BY station ROWS UNBOUNDED PRECEDING))
       SELECT profile, station, least(hi, greatest(a, b)) AS climb, greatest(lo, least(a, b)) AS descent FROM e""",
)
def running_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.envelope(net.profiles(spark, sf_dir))


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("side"), (F.col("z_u") + F.col("edge_id") % 13).alias("z")), F.struct(F.col("v").alias("node"), F.lit(1).alias("side"), (F.col("z_v") - F.col("edge_id") % 7).alias("z")))
    return net.edges(spark, sf_dir).select("edge_id", F.inline(ends))


@query(
    "reconcile_nodes",
    """WITH e AS (SELECT edge_id, u AS node, 0 AS side, z_u + edge_id % 13 AS z FROM edge UNION ALL SELECT edge_id, v, 1, z_v - edge_id % 7 FROM edge), m AS (SELECT node, avg(z) AS m FROM e GROUP BY node)
       SELECT edge_id, round(max(CASE WHEN side = 0 THEN m - z END), 6) AS lift_start, round(max(CASE WHEN side = 1 THEN m - z END), 6) AS lift_end FROM e JOIN m USING (node) GROUP BY edge_id""",
)
def reconcile_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.reconcile(_ends(spark, sf_dir)).select("edge_id", F.round("lift_start", 6).alias("lift_start"), F.round("lift_end", 6).alias("lift_end"))


@query("rectify_profile")
def rectify_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.rectify_profiles(net.profiles(spark, sf_dir), 0.01)


def _fits_sql() -> str:
    """For each width of window the matrix of the least-squares parabola: what each height weighs at each place."""
    rows = []
    for wide in (5, 7, 9, 11):
        at = np.vander(np.arange(wide) - wide // 2, profiles.ORDER + 1, increasing=True)
        for o, line in enumerate(at @ np.linalg.pinv(at)):
            rows += [f"({wide}, {o}, {k}, {weight!r}::DOUBLE)" for k, weight in enumerate(line.tolist())]
    return ", ".join(rows)


@query(
    "savgol_profile",
    f"""WITH fit AS (SELECT * FROM (VALUES {_fits_sql()}) AS t(wide, o, k, weight)),
            n AS (SELECT profile, count(*) AS n, least(11, count(*) - CASE WHEN count(*) % 2 = 0 THEN 1 ELSE 0 END) AS wide FROM profile GROUP BY profile),
            p AS (SELECT profile, station, z / 100.0::DOUBLE AS z, n, wide, greatest(0, least(station - wide // 2, n - wide)) AS start FROM profile JOIN n USING (profile))
       SELECT a.profile, a.station, round(sum(f.weight * b.z), 4) AS z FROM p a JOIN p b ON b.profile = a.profile AND b.station BETWEEN a.start AND a.start + a.wide - 1
       JOIN fit f ON f.wide = a.wide AND f.o = a.station - a.start AND f.k = b.station - a.start WHERE a.wide >= 5 GROUP BY a.profile, a.station
       UNION ALL SELECT profile, station, round(z, 4) FROM p WHERE wide < 5""",
)
def savgol_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.smooth_profiles(net.profiles(spark, sf_dir), 0.01).withColumn("z", F.round("z", 4))


@query(
    "structure_solve",
    """WITH known AS MATERIALIZED (SELECT node, z::DOUBLE AS z FROM node WHERE node IN (SELECT u FROM edge WHERE cls <> 'primary' UNION SELECT v FROM edge WHERE cls <> 'primary')),
            way AS MATERIALIZED (SELECT u, v, 1 / greatest(len, 1)::DOUBLE AS w FROM edge UNION ALL SELECT v, u, 1 / greatest(len, 1)::DOUBLE FROM edge),
            loose AS MATERIALIZED (SELECT w.* FROM way w ANTI JOIN known k ON k.node = w.u),
            state(i, node, z) USING KEY (node) AS (
                SELECT 0, u, (SELECT avg(z) FROM known) FROM (SELECT DISTINCT u FROM loose)
                UNION
                SELECT max(t.i) + 1, l.u, sum(l.w * coalesce(s.z, k.z)) / sum(l.w) FROM loose l JOIN state t ON t.node = l.u LEFT JOIN recurring.state s ON s.node = l.v LEFT JOIN known k ON k.node = l.v WHERE t.i < 400 GROUP BY l.u)
       SELECT node, round(z, 3) AS z FROM state UNION ALL SELECT node, round(z, 3) FROM known""",
)
def structure_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of corners that only bridges reach."""
    edges = net.edges(spark, sf_dir)
    ends = lambda df: df.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    known = net.nodes(spark, sf_dir).select("node", "z").join(ends(edges.where("cls <> 'primary'")), "node", "left_semi")
    return profiles.relax_structures(edges.select("u", "v", "len"), known).select("node", F.round("z", 3).alias("z"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.nodes(spark, sf_dir).select(F.col("row").alias("r"), F.col("col").alias("c"), "z")


_SPOT = "spot AS (SELECT c_custkey AS spot, (c_custkey * 37 % 1000) / 1000.0::DOUBLE * (w - 1) + 0.5 AS px, (c_custkey * 91 % 1000) / 1000.0::DOUBLE * (w - 1) + 0.5 AS py FROM customer, w)"


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, key = net.width(spark, sf_dir), F.col("c_custkey")
    return net.table(spark, sf_dir, "customer").select(key.alias("spot"), (key * 37 % 1000 / 1000 * (w - 1) + 0.5).alias("px"), (key * 91 % 1000 / 1000 * (w - 1) + 0.5).alias("py"))


@query(
    "bilinear_sample",
    f"""WITH {_SPOT}, s AS (SELECT spot, px - 0.5 AS fx, py - 0.5 AS fy, CAST(floor(px - 0.5) AS BIGINT) AS c0, CAST(floor(py - 0.5) AS BIGINT) AS r0 FROM spot)
       SELECT spot, round(sum(z * CASE WHEN n.col = c0 THEN 1 - (fx - c0) ELSE fx - c0 END * CASE WHEN n.row = r0 THEN 1 - (fy - r0) ELSE fy - r0 END), 5) AS z
       FROM s JOIN node n ON n.col BETWEEN c0 AND c0 + 1 AND n.row BETWEEN r0 AND r0 + 1 GROUP BY spot HAVING count(*) = 4""",
)
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.sample(_spots(spark, sf_dir), _cells(spark, sf_dir), "spot").select("spot", F.round("z", 5).alias("z"))


@query(
    "hillshade",
    """WITH g AS (SELECT a.row AS r, a.col AS c, (e.z - w.z) / 20000.0::DOUBLE * 1.6 AS gx, (s.z - n.z) / 20000.0::DOUBLE * 1.6 AS gy FROM node a
            JOIN node e ON e.row = a.row AND e.col = a.col + 1 JOIN node w ON w.row = a.row AND w.col = a.col - 1 JOIN node s ON s.col = a.col AND s.row = a.row + 1 JOIN node n ON n.col = a.col AND n.row = a.row - 1),
            k AS (SELECT *, pi() / 2 - atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(-gx, gy) AS aspect FROM g)
       SELECT r, c, round(greatest(0, least(1, sin(radians(45)) * sin(slope) + cos(radians(45)) * cos(slope) * cos(radians(360 - 315 + 90) - aspect))), 6) AS shade FROM k""",
)
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.hillshade(_cells(spark, sf_dir), net.CELL).select("r", "c", F.round("shade", 6).alias("shade"))


@query(
    "smooth_raster",
    """WITH across AS (SELECT a.row AS r, a.col AS c, sum(b.z * exp(-pow(b.col - a.col, 2) / 2.0)) / sum(exp(-pow(b.col - a.col, 2) / 2.0)) AS z FROM node a JOIN node b ON b.row = a.row AND abs(b.col - a.col) <= 3 GROUP BY ALL)
       SELECT a.r, a.c, round(sum(b.z * exp(-pow(b.r - a.r, 2) / 2.0)) / sum(exp(-pow(b.r - a.r, 2) / 2.0)), 4) AS z FROM across a JOIN across b ON b.c = a.c AND abs(b.r - a.r) <= 3 GROUP BY ALL""",
)
def smooth_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.smooth(_cells(spark, sf_dir), 1.0).select("r", "c", F.round("z", 4).alias("z"))


@query(
    "water_mask",
    """WITH cell AS (SELECT row AS r, col AS c, z / 100.0::DOUBLE AS z FROM node),
            wet AS MATERIALIZED (SELECT a.r, a.c FROM cell a JOIN cell b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c, a.z HAVING max(b.z) - min(b.z) < 40 OR a.z < 32),
            l AS MATERIALIZED (SELECT a.r * 100000 + a.c AS a, b.r * 100000 + b.c AS b FROM wet a JOIN wet b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
            k(node, component) USING KEY (node) AS (
                SELECT DISTINCT a, a FROM l
                UNION
                SELECT n.node, min(n.component) FROM (SELECT l.b AS node, k.component FROM k JOIN l ON l.a = k.node) n LEFT JOIN recurring.k r ON r.node = n.node WHERE n.component < r.component GROUP BY n.node),
            kept AS (SELECT node // 100000 AS r, node % 100000 AS c FROM k WHERE component IN (SELECT component FROM k GROUP BY component HAVING count(*) >= 12)),
            core AS (SELECT a.r, a.c FROM kept a JOIN kept b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c HAVING count(*) = 9)
       SELECT DISTINCT a.r, a.c FROM kept a JOIN core b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1""",
)
def water_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.water_mask(_cells(spark, sf_dir).withColumn("z", F.col("z") / 100), 40.0, 32.0, 12)


@query(
    "edge_profiles",
    """SELECT edge_id, 21 AS n, round(z_u, 3)::DOUBLE AS z_first, round(z_v, 3)::DOUBLE AS z_last FROM edge JOIN node a ON a.node = u, w
       WHERE EXISTS (SELECT 1 FROM node n WHERE n.col = a.col + 1 AND n.row = a.row + 1)
         AND CASE WHEN segment LIKE 'r%' THEN EXISTS (SELECT 1 FROM node n WHERE n.col = a.col + 2 AND n.row = a.row + 1) ELSE EXISTS (SELECT 1 FROM node n WHERE n.col = a.col + 1 AND n.row = a.row + 2) END""",
)
def edge_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights every 5 m along each edge, off the raster of corners: (edge_id, n, z_first, z_last)."""
    place = net.nodes(spark, sf_dir).select(F.col("node").alias("u"), "col", "row")
    rows = net.edges(spark, sf_dir).join(place, "u").withColumn("right", F.col("segment").startswith("r"))
    samples = rows.select("edge_id", "right", "col", "row", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i / 20)).alias("i", "f"))
    spots = samples.select(F.struct("edge_id", "i").alias("spot"), (F.col("col") + F.when(F.col("right"), F.col("f")).otherwise(0.0) + 0.5).alias("px"), (F.col("row") + F.when(F.col("right"), 0.0).otherwise(F.col("f")) + 0.5).alias("py"))
    z = raster.sample(spots, _cells(spark, sf_dir), "spot").select("spot.*", "z")
    rows = z.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min_by("z", "i"), 3).alias("z_first"), F.round(F.max_by("z", "i"), 3).alias("z_last"))
    return rows.where("n = 21")  # at the grid's rim the raster has no cells around a sample
