"""Queries over clipping, reliability, overrides, both modes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.config import Settings
from slopewise.functions import geometry
from slopewise.operators import costs, paths
from slopewise.plans import lookup, routing, streets, terrain
from slopewise.plans.registry import query
from slopewise.sources import street_network as net


@query(
    "city_clip",
    f"""WITH {streets._MIDDLE}, town AS (SELECT * FROM hood WHERE hood % 100 BETWEEN 1 AND 4)
        SELECT edge_id FROM middle m WHERE EXISTS (SELECT 1 FROM town t WHERE pow(greatest(t.x0 - m.x, 0, m.x - t.x1), 2) + pow(greatest(t.y0 - m.y, 0, m.y - t.y1), 2) <= 625000000)""",
)
def city_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose middle is within 250 m of the town's neighbourhoods."""
    town, reach, size = net.hoods(spark, sf_dir).where("hood % 100 between 1 and 4"), 100 * Settings().city_buffer, 8 * net.CELL
    cell = lambda c: F.floor(c / size).cast("long")
    posted = town.withColumn("cx", F.explode(F.sequence(cell(F.col("x0") - reach), cell(F.col("x1") + reach)))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0") - reach), cell(F.col("y1") + reach))))
    points = streets._middles(spark, sf_dir).select("edge_id", "x", "y", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    out = lambda low, at, high: F.greatest(F.col(low) - F.col(at), F.lit(0), F.col(at) - F.col(high))
    return points.join(posted, ["cx", "cy"]).where(out("x0", "x", "x1") ** 2 + out("y0", "y", "y1") ** 2 <= reach**2).select("edge_id").distinct()


@query("reliable_grades", "SELECT edge_id, len >= 9000 AS reliable, CASE WHEN len >= 9000 THEN round(abs(z_v - z_u) / len, 8) END AS grade FROM edge")
def reliable_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of edges that are long enough to trust, null for the others."""
    rows = net.edges(spark, sf_dir).withColumn("reliable", F.col("len") >= 9000)
    return rows.select("edge_id", "reliable", F.when(F.col("reliable"), F.round(F.abs(F.col("z_v") - F.col("z_u")) / F.col("len"), 8)).alias("grade"))


@query("resolved_profiles", "SELECT profile, count(*) AS n FROM profile GROUP BY profile HAVING bool_and(z < 15000)")
def resolved_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles all of whose heights are known; here heights over 150 m count as unknown."""
    rows = net.profiles(spark, sf_dir).groupBy("profile").agg(F.collect_list(F.when(F.col("z") < 15_000, F.col("z").cast("double")).otherwise(float("nan"))).alias("z"))
    return rows.where(F.forall("z", lambda h: ~F.isnan(h))).select("profile", F.size("z").cast("long").alias("n"))


@query(
    "line_parts",
    """WITH l AS (SELECT profile, station, dist, z / 100.0::DOUBLE AS y, dist - lag(dist) OVER o AS dx, (z - lag(z) OVER o) / 100.0::DOUBLE AS dy FROM profile WINDOW o AS (PARTITION BY profile ORDER BY station)),
            c AS (SELECT *, sum(coalesce(sqrt(dx * dx + dy * dy), 0)) OVER (PARTITION BY profile ORDER BY station) AS upto, sum(coalesce(sqrt(dx * dx + dy * dy), 0)) OVER (PARTITION BY profile) AS whole FROM l)
       SELECT profile, count(*) FILTER (WHERE upto > 0.25::DOUBLE * whole AND upto < 0.75::DOUBLE * whole) + 2 AS points, round(max(whole) / 2, 4) AS length FROM c GROUP BY profile HAVING count(*) > 1""",
)
def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle half of each profile's line: how many points it has and how long it is."""
    rows = streets._lines(spark, sf_dir).select("profile", geometry.part(F.col("line"), F.lit(0.25), F.lit(0.75)).alias("p"), F.size("line"))
    return rows.select("profile", F.size("p").cast("long").alias("points"), F.round(geometry.length(F.col("p")), 4).alias("length"))


@query("place_overrides", f"WITH {lookup._PLACES} SELECT place, name, CASE name WHEN 'blue bolt' THEN 123 ELSE x END AS x, CASE name WHEN 'blue bolt' THEN 456 ELSE y END AS y FROM place WHERE name IS NOT NULL")
def place_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at their corrected points, where a correction by name is known."""
    fixed = spark.createDataFrame([("blue bolt", 123, 456)], "name string, fx long, fy long")
    rows = lookup.place_table(spark, sf_dir).where("name is not null").join(F.broadcast(fixed), "name", "left")
    return rows.select("place", "name", F.coalesce("fx", "x").alias("x"), F.coalesce("fy", "y").alias("y"))


_BIKE = routing.routes_sql(routing.OBJECTIVES, "bike")


@query("bike_route_summary", f"WITH {_BIKE} SELECT objective, request, CAST(sum(len) AS BIGINT) AS distance, CAST(sum(gain) AS BIGINT) AS gain FROM step JOIN arc USING (arc_id) GROUP BY objective, request")
def bike_route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trips by bicycle, on its own network and with its own comfort."""
    rows = routing.trips(spark, sf_dir, "bike").join(net.arcs(spark, sf_dir).select("arc_id", "len", "gain"), "arc_id")
    return rows.groupBy("objective", "request").agg(F.sum("len").alias("distance"), F.sum("gain").alias("gain"))


@query(
    "wiggle_streets",
    f"""WITH {routing._ROUTES}, n AS (SELECT request, objective, list_sort(list(DISTINCT name)) AS names FROM step JOIN arc USING (arc_id) GROUP BY ALL)
        SELECT f.request, len(list_intersect(f.names, s.names)) AS shared, len(f.names) AS flat, len(s.names) AS short FROM n f JOIN n s ON s.request = f.request AND s.objective = 'shortest' WHERE f.objective = 'min_climb'""",
)
def wiggle_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many named streets the flattest and the shortest route of a trip share."""
    rows = routing.trips(spark, sf_dir, objectives=(costs.SHORTEST, costs.MIN_CLIMB)).join(routing._measured(spark, sf_dir), "arc_id")
    names = rows.groupBy("request").agg(F.collect_set(F.when(F.col("objective") == "min_climb", F.col("name"))).alias("f"), F.collect_set(F.when(F.col("objective") == "shortest", F.col("name"))).alias("s"))
    rows = names.where((F.size("f") > 0) & (F.size("s") > 0))
    return rows.select("request", F.size(F.array_intersect("f", "s")).cast("long").alias("shared"), F.size("f").cast("long").alias("flat"), F.size("s").cast("long").alias("short"))


@query(
    "run_summary",
    f"""WITH {routing._COMPARED} SELECT round(avg(detour_ratio) FILTER (WHERE objective = 'balanced'), 6) AS detour, round(avg(saved_pct) FILTER (WHERE objective = 'balanced'), 4) AS saved_pct, max(max_grade) FILTER (WHERE objective = 'balanced') AS max_grade,
               (SELECT round(sum(gain) / (sum(len) / 100000.0::DOUBLE), 6) FROM arc WHERE walk) AS gain_per_km, (SELECT count(*) FROM edge) AS edges FROM compared""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row that sums up a run, as a sweep collects them."""
    own = lambda f, c: f(F.when(F.col("objective") == "balanced", F.col(c)))
    rows = routing._compared(spark, sf_dir).agg(F.round(own(F.avg, "detour_ratio"), 6).alias("detour"), F.round(own(F.avg, "saved_pct"), 4).alias("saved_pct"), own(F.max, "max_grade").alias("max_grade"))
    # Three tables of one row each.
    return rows.join(F.broadcast(terrain.gain_per_km(spark, sf_dir))).join(F.broadcast(net.edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges"))))


@query("basin_layer", f"WITH {terrain._BASINS} SELECT basin, count(*) AS corners, CAST(min(x) AS BIGINT) AS x0, CAST(min(y) AS BIGINT) AS y0, CAST(max(x) AS BIGINT) AS x1, CAST(max(y) AS BIGINT) AS y1, min(z) AS lowest FROM basin JOIN node USING (node) GROUP BY basin")
def basin_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins as a map layer: box, corners and lowest point."""
    rows = terrain.basins(spark, sf_dir).join(net.nodes(spark, sf_dir).select("node", "x", "y", "z"), "node")
    return rows.groupBy("basin").agg(F.count(F.lit(1)).alias("corners"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.min("z").alias("lowest"))


@query("route_keys", f"WITH {routing._ROUTES}, r AS (SELECT objective, request, list(arc_id ORDER BY pos) AS arcs FROM step GROUP BY ALL) SELECT request, min(objective) AS objective, count(*) AS n FROM r GROUP BY request, arcs")
def route_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct routes of each trip; the first objective by name speaks for equal ones."""
    objectives = tuple(o.name for o in routing.OBJECTIVES)
    rows = paths.routes(routing.all_costs(spark, sf_dir, "walk", routing.OBJECTIVES), routing._requests(spark, sf_dir), objectives)
    return rows.groupBy("request", "arcs").agg(F.min("objective").alias("objective"), F.count(F.lit(1)).alias("n")).drop("arcs")
