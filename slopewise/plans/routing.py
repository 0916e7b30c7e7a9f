"""Queries over routes between neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.operators import costs, paths, runs
from slopewise.operators.costs import OBJECTIVES, Objective, arc_cost, cost_sql
from slopewise.plans.registry import query
from slopewise.plans.streets import _FACTS, access_points
from slopewise.session import cut
from slopewise.sources import street_network as net

#: Of two ways that cost the same, this share of a centimetre decides; it makes routes unique on any engine.
TIE, TIE_SQL = "((arc_id * 7919) % 10007) / 1024D", "((arc_id * 7919) % 10007) / 1024.0::DOUBLE"


def network(spark: SparkSession, sf_dir: str, mode: str, objective: Objective) -> DataFrame:
    """The arcs of a mode with their cost; parallel ones stay, as the search takes the cheapest anyway."""
    return all_costs(spark, sf_dir, mode, (objective,)).withColumnRenamed(objective.name, "cost")


def _walk_sql(objectives=(costs.BALANCED,), mode: str = "walk") -> str:
    each = " UNION ALL ".join(f"SELECT '{o.name}' AS objective, src, dst, arc_id, {cost_sql(o, mode)} + {TIE_SQL} AS cost FROM arc WHERE {mode}" for o in objectives)
    return f"street AS MATERIALIZED (SELECT objective, src, dst, min(cost) AS cost, arg_min(arc_id, cost) AS arc_id FROM ({each}) GROUP BY ALL)"


def _costs(objective: Objective, mode: str) -> None:
    @query(f"edge_costs_{objective.name}_{mode}", f"SELECT arc_id, round({cost_sql(objective, mode)}, 4) AS cost FROM arc WHERE {mode}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return costs.costed(net.arcs(spark, sf_dir), mode, objective).select("arc_id", F.round("cost", 4).alias("cost"))


for _objective in OBJECTIVES:
    for _mode in ("walk", "bike"):
        _costs(_objective, _mode)


@query(
    "best_parallel_arc",
    f"""WITH c AS (SELECT src, dst, arc_id, {cost_sql(costs.SHORTEST, "walk")} AS cost FROM arc WHERE walk)
        SELECT src, dst, arc_id, cost FROM c QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY cost, arc_id DESC) = 1""",
)
def best_parallel_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.best_parallel(costs.costed(net.arcs(spark, sf_dir), "walk", costs.SHORTEST))


_TREE = """tree(source, node, cost) USING KEY (source, node) AS (
        SELECT node, node, 0.0::DOUBLE FROM start
        UNION
        SELECT n.source, n.node, min(n.cost) FROM (SELECT t.source, s.dst AS node, t.cost + s.cost AS cost FROM tree t JOIN street s ON s.src = t.node) n
        LEFT JOIN recurring.tree r ON r.source = n.source AND r.node = n.node WHERE r.cost IS NULL OR n.cost < r.cost GROUP BY n.source, n.node)"""
_CENTRE = "start AS (SELECT node FROM node, w ORDER BY abs(col - w // 2) + abs(row - w // 2), node LIMIT 1)"


def centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = net.width(spark, sf_dir) // 2
    return net.nodes(spark, sf_dir).orderBy(F.abs(F.col("col") - half) + F.abs(F.col("row") - half), "node").limit(1)


@query("shortest_cost", f"WITH {_walk_sql()}, {_CENTRE}, {_TREE} SELECT source, node, round(cost, 3) AS cost FROM tree")
def shortest_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.distances(network(spark, sf_dir, "walk", costs.BALANCED), centre(spark, sf_dir).select(F.col("node").alias("source")))
    return found.select("source", "node", F.round("cost", 3).alias("cost"))


@query(
    "pair_matrix",
    f"WITH {_walk_sql()}, {_FACTS}, start AS (SELECT node FROM access_point), {_TREE} SELECT source AS origin, node AS destination, round(cost, 3) AS cost FROM tree WHERE node IN (SELECT node FROM access_point) AND source <> node",
)
def pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = access_points(spark, sf_dir)
    found = paths.distances(network(spark, sf_dir, "walk", costs.BALANCED), points.select(F.col("node").alias("source")))
    ends = points.select("node")
    return found.join(ends, "node", "left_semi").where("source <> node").select(F.col("source").alias("origin"), F.col("node").alias("destination"), F.round("cost", 3).alias("cost"))


def _requests(spark: SparkSession, sf_dir: str, only_first: bool = False, rank: int = 0) -> DataFrame:
    """Trips between all ordered pairs of neighbourhoods, or those from the first alone; request is origin * 1000 + destination."""
    points = cut(access_points(spark, sf_dir, rank).withColumn("hood", F.col("hood").cast("long")))
    starts = points.select(F.col("hood").alias("origin"), F.col("node").alias("source"))
    if only_first:
        starts = starts.orderBy("origin").limit(1)
    # Neighbourhoods are a few dozen blocks of the grid, HOODS squared at most.
    return points.join(F.broadcast(starts)).where("node <> source").select((F.col("origin") * 1000 + F.col("hood")).alias("request"), "source", F.col("node").alias("target"))


def all_costs(spark: SparkSession, sf_dir: str, mode: str, objectives: tuple[Objective, ...]) -> DataFrame:
    """The arcs of a mode with a cost column for each objective, named like it."""
    return net.arcs(spark, sf_dir).where(F.col(mode)).select("src", "dst", "arc_id", *[(arc_cost(o, mode) + F.expr(TIE)).alias(o.name) for o in objectives])


def trips(spark: SparkSession, sf_dir: str, mode: str = "walk", objectives: tuple[Objective, ...] = OBJECTIVES, requests: DataFrame | None = None) -> DataFrame:
    """(objective, request, pos, arc_id) of all trips under all objectives."""
    asked = _requests(spark, sf_dir) if requests is None else requests
    return paths.steps(paths.routes(all_costs(spark, sf_dir, mode, objectives), asked, tuple(o.name for o in objectives)))


def routes_sql(objectives: tuple[Objective, ...], mode: str = "walk", only_first: bool = False) -> str:
    """Tables up to step (objective, request, pos, arc_id), the routes of all trips."""
    return f"""{_walk_sql(objectives, mode)}, {_FACTS},
    start AS (SELECT hood AS origin, node FROM access_point {"ORDER BY hood LIMIT 1" if only_first else ""}),
    tree(objective, origin, node, cost, via) USING KEY (objective, origin, node) AS (
        SELECT objective, origin, node, 0.0::DOUBLE, CAST(-1 AS BIGINT) FROM start, (SELECT DISTINCT objective FROM street)
        UNION
        SELECT n.objective, n.origin, n.node, min(n.cost), arg_min(n.via, n.cost) FROM (SELECT t.objective, t.origin, s.dst AS node, t.cost + s.cost AS cost, s.arc_id AS via FROM tree t JOIN street s ON s.src = t.node AND s.objective = t.objective) n
        LEFT JOIN recurring.tree r ON r.objective = n.objective AND r.origin = n.origin AND r.node = n.node WHERE r.cost IS NULL OR n.cost < r.cost GROUP BY n.objective, n.origin, n.node),
    back AS (
        SELECT t.objective, t.origin, CAST(t.origin * 1000 + p.hood AS BIGINT) AS request, 0 AS up, t.via AS arc_id FROM tree t JOIN access_point p ON p.node = t.node WHERE t.via >= 0
        UNION ALL
        SELECT b.objective, b.origin, b.request, b.up + 1, t.via FROM back b JOIN arc a ON a.arc_id = b.arc_id JOIN tree t ON t.objective = b.objective AND t.origin = b.origin AND t.node = a.src WHERE t.via >= 0),
    step AS (SELECT objective, request, max(up) OVER (PARTITION BY objective, request) - up AS pos, arc_id FROM back)"""


_ROUTES = routes_sql(OBJECTIVES)


@query("route_steps", f"WITH {_ROUTES} SELECT objective, request, pos, arc_id FROM step")
def route_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.col("direction") == "fwd"
    return net.arcs(spark, sf_dir).select("arc_id", "edge_id", "src", "dst", "len", "gain", "loss", "name", "cls", F.when(up, F.col("z_u")).otherwise(F.col("z_v")).alias("z_from"), F.when(up, F.col("z_v")).otherwise(F.col("z_u")).alias("z_to"))


def summaries(spark: SparkSession, sf_dir: str, steps: DataFrame | None = None) -> DataFrame:
    rows = (trips(spark, sf_dir) if steps is None else steps).withColumn("request", F.struct("objective", "request"))
    return paths.summary(rows, _measured(spark, sf_dir)).select("request.*", *["n", "distance", "gain", "loss", "net", "max_grade", "avg_abs_grade", "p95_grade"])


_SUMMARY = f"""{_ROUTES},
    summary AS (
        SELECT objective, request, count(*) AS n, CAST(sum(len) AS BIGINT) AS distance, CAST(sum(gain) AS BIGINT) AS gain, CAST(sum(loss) AS BIGINT) AS loss,
               arg_max(CASE direction WHEN 'fwd' THEN z_v ELSE z_u END, pos) - arg_min(CASE direction WHEN 'fwd' THEN z_u ELSE z_v END, pos) AS net,
               round(max(gain / len), 8) AS max_grade, round(sum(gain + loss) / sum(len), 8) AS avg_abs_grade, round(quantile_cont(gain / len, 0.95), 8) AS p95_grade
        FROM step JOIN arc USING (arc_id) GROUP BY objective, request)"""


@query("route_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir)


def _compared(spark: SparkSession, sf_dir: str, steps: DataFrame | None = None) -> DataFrame:
    rows = summaries(spark, sf_dir, steps).withColumns({"mode": F.lit("walk"), "origin": F.expr("request div 1000"), "destination": F.col("request") % 1000})
    return paths.comparisons(rows)


_COMPARED = f"""{_SUMMARY},
    compared AS (
        SELECT s.*, s.distance - b.distance AS detour, b.gain - s.gain AS saved, round(s.distance / b.distance, 8) AS detour_ratio,
               CASE WHEN b.gain > 0 THEN round(100 * (b.gain - s.gain) / b.gain, 6) WHEN b.gain IS NOT NULL THEN 0 END AS saved_pct,
               CASE WHEN s.distance - b.distance > 100 THEN round((b.gain - s.gain) / (s.distance - b.distance), 8) END AS efficiency
        FROM summary s LEFT JOIN summary b ON b.request = s.request AND b.objective = 'shortest')"""


@query("pair_comparisons", f"WITH {_COMPARED} SELECT objective, request, detour, saved, detour_ratio, saved_pct, efficiency FROM compared")
def pair_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("objective", "request", "detour", "saved", "detour_ratio", "saved_pct", "efficiency")


@query("mean_by_profile", f"WITH {_COMPARED} SELECT objective, count(*) AS n, round(avg(detour_ratio), 6) AS detour_ratio, round(avg(saved_pct), 4) AS saved_pct, round(avg(gain), 3) AS gain, round(avg(distance), 3) AS distance, max(max_grade) AS max_grade FROM compared GROUP BY objective")
def mean_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).groupBy("objective").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("detour_ratio"), 6).alias("detour_ratio"), F.round(F.avg("saved_pct"), 4).alias("saved_pct"), F.round(F.avg("gain"), 3).alias("gain"), F.round(F.avg("distance"), 3).alias("distance"), F.max("max_grade").alias("max_grade")
    )


@query(
    "pareto_front",
    f"""WITH {_SUMMARY} SELECT objective, request, distance, gain, max_grade FROM summary s WHERE NOT EXISTS (
        SELECT 1 FROM summary o WHERE o.request = s.request AND o.distance <= s.distance AND o.gain <= s.gain AND o.max_grade <= s.max_grade AND (o.distance < s.distance OR o.gain < s.gain OR o.max_grade < s.max_grade))""",
)
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summaries(spark, sf_dir).select("objective", "request", "distance", "gain", "max_grade")
    return paths.non_dominated(rows, ["request"], ["distance", "gain", "max_grade"])


@query(
    "halving_detour",
    f"""WITH {_COMPARED}, h AS (SELECT request, min(detour_ratio) FILTER (WHERE saved_pct >= 50) AS halved, max(saved_pct) AS best FROM compared GROUP BY request)
        SELECT count(*) AS trips, count(halved) AS halvable, round(median(halved), 6) AS median_detour, round(max(best), 4) AS best FROM h""",
)
def halving_detour(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips_ = _compared(spark, sf_dir).groupBy("request").agg(F.min(F.when(F.col("saved_pct") >= 50, F.col("detour_ratio"))).alias("halved"), F.max("saved_pct").alias("best"))
    return trips_.agg(F.count(F.lit(1)).alias("trips"), F.count("halved").alias("halvable"), F.round(F.median("halved"), 6).alias("median_detour"), F.round(F.max("best"), 4).alias("best"))


@query(
    "street_runs",
    f"""WITH {_ROUTES}, s AS (SELECT request, pos, name, len FROM step JOIN arc USING (arc_id) WHERE objective = 'shortest'),
            a AS (SELECT request, run, name, sum(len) AS len, min(pos) AS start FROM (SELECT *, sum(CASE WHEN name IS NOT DISTINCT FROM prev AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY request ORDER BY pos) AS run
                  FROM (SELECT *, lag(name) OVER (PARTITION BY request ORDER BY pos) AS prev FROM s)) GROUP BY ALL),
            k AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY start) AS k, lag(name) OVER (PARTITION BY request ORDER BY start) AS prev FROM a WHERE coalesce(name, '') <> '' AND len >= 9000),
            b AS (SELECT request, run, name, sum(len) AS len, min(start) AS start FROM (SELECT * EXCLUDE (run), sum(CASE WHEN name = prev THEN 0 ELSE 1 END) OVER (PARTITION BY request ORDER BY start) AS run FROM k) GROUP BY ALL)
       SELECT request, row_number() OVER (PARTITION BY request ORDER BY start) AS run, name, CAST(len AS BIGINT) AS len FROM b""",
)
def street_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trips(spark, sf_dir, objectives=(costs.SHORTEST,)).join(_measured(spark, sf_dir), "arc_id")
    return runs.street_runs(rows.select(F.col("request").alias("route"), "pos", "name", "len"), 9000).withColumnRenamed("route", "request")


SCALED = (*(costs.BALANCED.scaled(x) for x in costs.SWEEP), costs.MIN_CLIMB)
SCALE_OF = dict(zip((o.name for o in SCALED), (*costs.SWEEP, 1e9), strict=True))


@query(
    "weight_sweep",
    f"""WITH {routes_sql(SCALED, only_first=True)}, r AS (SELECT request, CASE objective {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SCALE_OF.items())} END AS scale, list(arc_id ORDER BY pos) AS arcs FROM step GROUP BY ALL),
            once AS (SELECT request, arcs, min(scale) AS scale FROM r GROUP BY request, arcs),
            s AS (SELECT request, scale, CAST(sum(len) AS BIGINT) AS distance, CAST(sum(gain) AS BIGINT) AS gain, round(max(gain / len), 8) AS max_grade FROM (SELECT request, scale, unnest(arcs) AS arc_id FROM once) JOIN arc USING (arc_id) GROUP BY request, scale)
       SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.request = s.request AND o.distance <= s.distance AND o.gain <= s.gain AND o.max_grade <= s.max_grade AND (o.distance < s.distance OR o.gain < s.gain OR o.max_grade < s.max_grade))""",
)
def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct routes over the scales of the sweep and the flattest objective; the smallest scale speaks for equal routes. The pairs swept are those from the first neighbourhood."""
    from pyspark.sql import Window as W

    rows = paths.routes(all_costs(spark, sf_dir, "walk", SCALED), _requests(spark, sf_dir, only_first=True), tuple(SCALE_OF)).withColumn("scale", net.choose(F.col("objective"), SCALE_OF))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("request", "arcs").orderBy("scale"))).where("r = 1")
    steps = first.select(F.struct("request", "scale").alias("request"), F.posexplode("arcs").alias("pos", "arc_id"))
    return paths.non_dominated(paths.summary(steps, _measured(spark, sf_dir)).select("request.*", "distance", "gain", "max_grade"), ["request"], ["distance", "gain", "max_grade"])


def _two_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = net.arcs(spark, sf_dir).where("walk").withColumn("cost", F.col("len").cast("double"))
    best = costs.best_parallel(rows).select("arc_id")
    return rows.join(best, "arc_id", "left_semi").select("src", "dst", "arc_id", "cost", F.col("gain").cast("double").alias("gain"))


@query("frontier")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trade-offs between distance and climb for a trip through the middle of the grid, thinned to thirty."""
    w = net.width(spark, sf_dir)
    near = min(5, w // 2)
    source = (w // 2) * w + w // 2
    asked = spark.createDataFrame([(1, source, max(0, source - near * w - near))], "request long, source long, target long")
    return paths.thin(paths.frontier(_two_costs(spark, sf_dir), asked, "cost", "gain"))


@query("loops")
def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattest loops of about 3 km from the middle of the grid."""
    place = net.nodes(spark, sf_dir).select(F.col("node").alias("dst"), "x", "y")
    asked = centre(spark, sf_dir).select(F.lit(1).cast("long").alias("request"), F.col("node").alias("source"), F.lit(300_000.0).alias("wish"))
    return paths.round_trips(_two_costs(spark, sf_dir).join(place, "dst"), asked)


@query("trip_comparison", f"WITH {_COMPARED} SELECT objective, distance, gain, loss, max_grade, detour, saved, saved_pct FROM compared WHERE request = (SELECT max(request) FROM compared)")
def trip_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip across the grid under each objective, compared with the shortest."""
    asked = _requests(spark, sf_dir)
    last = asked.agg(F.max("request").alias("request"))
    asked = asked.join(F.broadcast(last), "request", "left_semi")
    steps = trips(spark, sf_dir, requests=asked).withColumn("request", F.struct("objective", "request"))
    rows = paths.summary(steps, _measured(spark, sf_dir)).select("request.objective", "request.request", "distance", "gain", "loss", "max_grade")
    rows = paths.comparisons(rows.withColumns({"mode": F.lit("walk"), "origin": F.expr("request div 1000"), "destination": F.col("request") % 1000}))
    return rows.select("objective", "distance", "gain", "loss", "max_grade", "detour", "saved", "saved_pct")
