"""Queries over components, passes, basins, barriers and corridors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.operators import access, corridors, costs, topology
from slopewise.operators.components import connected_components
from slopewise.plans import routing
from slopewise.plans.registry import query
from slopewise.plans.streets import _FACTS, _MIDDLE, _middles, access_points, hood_label_left
from slopewise.session import cut
from slopewise.sources import street_network as net

LOW, LEAST = 1500, 100_000
#: Trips under one objective each, which are counted, that are sent to all tasks.
MOST_TRIPS = 20_000


@query(
    "connected_components",
    """WITH l AS MATERIALIZED (SELECT u AS a, v AS b FROM edge WHERE cls IN ('residential', 'primary') UNION ALL SELECT v, u FROM edge WHERE cls IN ('residential', 'primary')),
            c(node, component) USING KEY (node) AS (
                SELECT DISTINCT a, a FROM l
                UNION
                SELECT n.node, min(n.component) FROM (SELECT l.b AS node, c.component FROM c JOIN l ON l.a = c.node) n LEFT JOIN recurring.c r ON r.node = n.node WHERE n.component < r.component GROUP BY n.node)
       SELECT node, component FROM c""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = net.edges(spark, sf_dir).where("cls in ('residential', 'primary')")
    return connected_components(links.select(F.col("u").alias("a"), F.col("v").alias("b")))


@query(
    "largest_scc",
    """WITH s AS MATERIALIZED (SELECT DISTINCT src, dst FROM arc WHERE bike), start AS (SELECT node FROM node, w WHERE node IN (SELECT src FROM s) ORDER BY abs(col - w // 2) + abs(row - w // 2), node LIMIT 1),
            there(node) USING KEY (node) AS (SELECT node FROM start UNION SELECT DISTINCT s.dst FROM there JOIN s ON s.src = there.node LEFT JOIN recurring.there r ON r.node = s.dst WHERE r.node IS NULL),
            back(node) USING KEY (node) AS (SELECT node FROM start UNION SELECT DISTINCT s.src FROM back JOIN s ON s.dst = back.node LEFT JOIN recurring.back r ON r.node = s.src WHERE r.node IS NULL)
       SELECT node FROM there JOIN back USING (node)""",
)
def largest_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.largest_strong_component(net.arcs(spark, sf_dir).where("bike").select("src", "dst", "arc_id"))


def _crests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.edges(spark, sf_dir).select("edge_id", "u", "v", "len", F.greatest("z_u", "z_v").cast("double").alias("crest"))


#: Crest and edge as one number, so that the lowest way over has one highest edge.
_MINIMAX = """hop AS MATERIALIZED (SELECT u AS a, v AS b, greatest(z_u, z_v) * 10000000000 + edge_id AS k FROM edge UNION ALL SELECT v, u, greatest(z_u, z_v) * 10000000000 + edge_id FROM edge),
    over(source, node, k) USING KEY (source, node) AS (
        SELECT node, node, CAST(-1 AS BIGINT) FROM start
        UNION
        SELECT n.source, n.node, min(n.k) FROM (SELECT o.source, h.b AS node, greatest(o.k, h.k) AS k FROM over o JOIN hop h ON h.a = o.node) n
        LEFT JOIN recurring.over r ON r.source = n.source AND r.node = n.node WHERE r.k IS NULL OR n.k < r.k GROUP BY n.source, n.node)"""
_MATRIX = f"{_FACTS}, start AS (SELECT node FROM access_point), {_MINIMAX}, matrix AS (SELECT source AS a, node AS b, (k // 10000000000)::DOUBLE AS height, k % 10000000000 AS edge_id FROM over WHERE source < node AND node IN (SELECT node FROM access_point))"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = access_points(spark, sf_dir)
    pairs = points.select(F.col("node").alias("a")).join(F.broadcast(points.select(F.col("node").alias("b"))), F.col("a") < F.col("b"))
    return topology.pass_heights(_crests(spark, sf_dir), pairs)


@query("bottleneck_height", f"WITH {_MATRIX} SELECT a, b, height, edge_id FROM matrix")
def bottleneck_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir)


@query(
    "critical_passes",
    f"""WITH {_MATRIX} SELECT edge_id, (SELECT count(*) FROM matrix m WHERE m.edge_id = x.edge_id) AS pairs, min(height) AS height, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS ends
        FROM (SELECT edge_id, height, a AS node FROM matrix UNION SELECT edge_id, height, b FROM matrix) x GROUP BY edge_id""",
)
def critical_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.critical_passes(matrix(spark, sf_dir))


@query("node_elevations", "SELECT node, median(z) AS z FROM (SELECT src AS node, CASE direction WHEN 'fwd' THEN z_u ELSE z_v END + edge_id % 7 AS z FROM arc UNION ALL SELECT dst, CASE direction WHEN 'fwd' THEN z_v ELSE z_u END + edge_id % 5 FROM arc) GROUP BY node")
def node_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median height of all ends of arcs that meet in a node; the ends are off by some centimetres."""
    up = F.col("direction") == "fwd"
    ends = F.array(
        F.struct(F.col("src").alias("node"), (F.when(up, F.col("z_u")).otherwise(F.col("z_v")) + F.col("edge_id") % 7).alias("z")),
        F.struct(F.col("dst").alias("node"), (F.when(up, F.col("z_v")).otherwise(F.col("z_u")) + F.col("edge_id") % 5).alias("z")),
    )
    return net.arcs(spark, sf_dir).select(F.inline(ends)).groupBy("node").agg(F.median("z").alias("z"))


def _basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = net.nodes(spark, sf_dir).select("node", "z")
    return topology.basins(net.edges(spark, sf_dir), heights, LOW + 2000, LEAST)


_BASINS = f"""low AS MATERIALIZED (SELECT least(u, v) AS a, greatest(u, v) AS b, min(len) AS len FROM edge WHERE z_u <= {LOW + 2000} AND z_v <= {LOW + 2000} GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM low UNION ALL SELECT b, a FROM low),
    c(node, component) USING KEY (node) AS (
        SELECT DISTINCT a, a FROM l
        UNION
        SELECT n.node, min(n.component) FROM (SELECT l.b AS node, c.component FROM c JOIN l ON l.a = c.node) n LEFT JOIN recurring.c r ON r.node = n.node WHERE n.component < r.component GROUP BY n.node),
    large AS (SELECT component FROM low JOIN c ON c.node = low.a GROUP BY component HAVING sum(len) >= {LEAST}),
    basin AS (SELECT node, component AS basin FROM c WHERE component IN (SELECT component FROM large))"""


@query("basins", f"WITH {_BASINS} SELECT node, basin FROM basin")
def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basins(spark, sf_dir)


@query(
    "basin_names",
    f"""WITH {_BASINS}, {_MIDDLE}, labelled AS (SELECT m.edge_id, min(hood) AS hood FROM middle m JOIN hood h ON m.x BETWEEN h.x0 AND h.x1 AND m.y BETWEEN h.y0 AND h.y1 GROUP BY m.edge_id),
            p AS (SELECT b.basin, hood, sum(len) AS len FROM edge e JOIN basin b ON b.node = e.u JOIN basin d ON d.node = e.v AND d.basin = b.basin JOIN labelled USING (edge_id) GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY len DESC, hood) AS r FROM p)
       SELECT basin, string_agg(CAST(hood AS VARCHAR), ' / ' ORDER BY r) FILTER (WHERE r <= 3) AS label,
              coalesce(string_agg(CAST(hood AS VARCHAR), '; ' ORDER BY CAST(hood AS VARCHAR)) FILTER (WHERE len > 20000), '') AS hoods FROM r GROUP BY basin""",
)
def basin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.basin_names(net.edges(spark, sf_dir), _basins(spark, sf_dir), hood_label_left(spark, sf_dir), 20_000)


@query("basin_passes")
def basin_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.basin_passes(_crests(spark, sf_dir), _basins(spark, sf_dir))


def _trip_edges(steps: DataFrame) -> DataFrame:
    return steps.select("request", "objective", net.edge_of("arc_id").alias("edge_id"), "arc_id")


_BARRIERS = f"""{routing._ROUTES}, used AS (SELECT DISTINCT objective, request, edge_id FROM step JOIN arc USING (arc_id) WHERE gain + loss >= len * 0.08::DOUBLE),
    kinds AS (SELECT greatest(1, count(DISTINCT objective) - 1) AS kinds FROM step),
    counts AS (SELECT edge_id, count(*) FILTER (WHERE objective = 'shortest') AS shortest, count(*) FILTER (WHERE objective <> 'shortest') / max(kinds) AS flat FROM used, kinds GROUP BY edge_id),
    barrier AS (SELECT edge_id, shortest, round(flat, 6) AS flat, round(least(1.0, flat / shortest), 6) AS unavoidable, round(shortest * (1 - least(1.0::DOUBLE, flat / shortest)), 6) AS score FROM counts WHERE shortest > 0)"""


@query("barriers", f"WITH {_BARRIERS} SELECT * FROM barrier")
def barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.barriers(routing.trips(spark, sf_dir), net.arcs(spark, sf_dir), 0.08)


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = cut(routing.trips(spark, sf_dir))
    compared = cut(routing._compared(spark, sf_dir, solved).select("request", "objective", "origin", "destination", "saved", "efficiency"))
    if compared.limit(MOST_TRIPS + 1).count() <= MOST_TRIPS:
        compared = F.broadcast(compared)
    steps = _trip_edges(solved).where("objective <> 'shortest'")
    return corridors.usage(steps, compared)


_USAGE = f"""{routing._COMPARED},
    once AS (SELECT DISTINCT request, objective, edge_id FROM step JOIN arc USING (arc_id) WHERE objective <> 'shortest'),
    usage AS (SELECT edge_id, count(DISTINCT request) AS pairs, len(list_distinct(flatten(list([request // 1000, request % 1000])))) AS span, CAST(sum(greatest(saved, 0)) AS BIGINT) AS climb_saved, round(coalesce(avg(efficiency), 0), 8) AS efficiency
              FROM once JOIN compared USING (request, objective) GROUP BY edge_id)"""


@query("edge_usage", f"WITH {_USAGE} SELECT * FROM usage")
def edge_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir)


_SCORES = f"""{_USAGE},
    high AS (SELECT coalesce(quantile_cont(climb_saved, 0.9), 1.0) AS high FROM usage WHERE climb_saved > 0),
    score AS (SELECT edge_id, flat, CASE WHEN flat THEN round(ln(1 + pairs) * ln(1 + span) * (1 + least(4, greatest(0, climb_saved / high))), 8) ELSE 0 END AS score
              FROM usage JOIN (SELECT edge_id, abs(z_v - z_u) / len <= 0.055::DOUBLE AND (len < 1500 OR (abs(z_v - z_u) + crown) / len <= 0.09::DOUBLE) AS flat FROM edge) USING (edge_id), high)"""


@query("edge_scores", f"WITH {_SCORES} SELECT * FROM score")
def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corridors.scores(cut(_usage(spark, sf_dir)), net.edges(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = cut(_usage(spark, sf_dir))
    return cut(corridors.scores(usage, net.edges(spark, sf_dir)).join(usage.drop("efficiency"), "edge_id"))


def _measured_edges(spark: SparkSession, sf_dir: str, some: DataFrame) -> DataFrame:
    """Those with an edge_id in some, taken before they are joined with their places."""
    place = net.nodes(spark, sf_dir).select("node", "x", "y")
    rows = net.edges(spark, sf_dir).join(some.select("edge_id"), "edge_id", "left_semi").withColumn("low_stress", access.low_stress(F.col("cls"), access.bike_facility(F.col("cls"), F.col("bike_ok"))))
    return rows.join(place.selectExpr("node as u", "x as x0", "y as y0"), "u").join(place.selectExpr("node as v", "x as x1", "y as y1"), "v")


def _corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return corridors.corridors(scored, _measured_edges(spark, sf_dir, scored.where("score > 0")))


def _parts_sql(name: str, links: str) -> str:
    """A table (node, component) of the links (a, b), which stand in both directions."""
    return f"""{name}(node, component) USING KEY (node) AS (
        SELECT DISTINCT a, a FROM {links}
        UNION
        SELECT n.node, min(n.component) FROM (SELECT l.b AS node, c.component FROM {name} c JOIN {links} l ON l.a = c.node) n LEFT JOIN recurring.{name} r ON r.node = n.node WHERE n.component < r.component GROUP BY n.node)"""


def _bridge_sql(most: int) -> str:
    """From core (edge_id, u, v) and free (edge_id, u, v, len): bridge (edge_id), the edges of the shortest ways of up to three edges between two parts of the core."""
    return f"""core_link AS MATERIALIZED (SELECT u AS a, v AS b FROM core UNION ALL SELECT v, u FROM core),
    {_parts_sql("core_part", "core_link")},
    gap AS (SELECT edge_id, u AS s, v AS t, len FROM free ANTI JOIN core USING (edge_id) UNION ALL SELECT edge_id, v, u, len FROM free ANTI JOIN core USING (edge_id)),
    way_1 AS (SELECT component AS home, t AS s, len AS total, [edge_id] AS path FROM core_part JOIN gap ON s = node WHERE len <= {most}),
    way_2 AS (SELECT home, t AS s, total + len AS total, list_append(path, edge_id) AS path FROM way_1 JOIN gap USING (s) WHERE NOT list_contains(path, edge_id) AND total + len <= {most}),
    way_3 AS (SELECT home, t AS s, total + len AS total, list_append(path, edge_id) AS path FROM way_2 JOIN gap USING (s) WHERE NOT list_contains(path, edge_id) AND total + len <= {most}),
    met AS (SELECT home, component AS other, total, path FROM (FROM way_1 UNION ALL FROM way_2 UNION ALL FROM way_3) JOIN core_part ON node = s WHERE home < component),
    bridge AS (SELECT DISTINCT unnest(path) AS edge_id FROM (SELECT path FROM met QUALIFY row_number() OVER (PARTITION BY home, other ORDER BY total, path) = 1))"""


_CORRIDORS = f"""{_SCORES}, level AS (SELECT quantile_cont(score, 0.93) AS cut FROM score WHERE score > 0),
    core AS MATERIALIZED (SELECT edge_id, u, v FROM score JOIN edge USING (edge_id), level WHERE score > 0 AND score >= cut),
    free AS MATERIALIZED (SELECT edge_id, u, v, len FROM score JOIN edge USING (edge_id), level WHERE score > 0 AND flat AND score >= cut * 0.45::DOUBLE),
    {_bridge_sql(22_000)},
    built AS MATERIALIZED (
        SELECT e.edge_id, e.u, e.v, len, e.name, score, pairs, span, climb_saved, abs(z_v - z_u) AS climb, (abs(z_v - z_u) + crown) / len AS steepest, z_u, z_v, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1,
               cls IN ('cycleway', 'residential') OR (cls = 'footway' AND bike_ok) AS low_stress
        FROM (SELECT edge_id FROM core UNION SELECT edge_id FROM bridge) JOIN edge e USING (edge_id) JOIN score USING (edge_id) JOIN usage USING (edge_id) JOIN node a ON a.node = e.u JOIN node b ON b.node = e.v),
    built_link AS MATERIALIZED (SELECT u AS a, v AS b FROM built UNION ALL SELECT v, u FROM built),
    {_parts_sql("built_part", "built_link")},
    strip AS MATERIALIZED (SELECT built.*, component AS corridor FROM built JOIN built_part ON node = u),
    named AS (SELECT corridor, string_agg(name, ' - ' ORDER BY r) AS names FROM (SELECT corridor, name, row_number() OVER (PARTITION BY corridor ORDER BY count(*) DESC, name) AS r FROM strip WHERE trim(name) <> '' GROUP BY corridor, name) WHERE r <= 4 GROUP BY corridor),
    piece AS MATERIALIZED (
        SELECT corridor, count(*) AS n, sum(len) AS length, avg(score) AS mean_score, sum(score) AS total_score, max(pairs) AS pairs, max(span) AS span, sum(climb_saved) AS climb_saved, sum(climb) / sum(len) AS mean_grade, max(steepest) AS max_grade,
               min(least(z_u, z_v)) AS z_min, max(greatest(z_u, z_v)) AS z_max, sum(greatest(z_v - z_u, 0)) / sum(len) * 1000 AS gain_per_km, sum(CASE WHEN low_stress THEN len ELSE 0 END) / sum(len) AS low_stress,
               list(DISTINCT name) FILTER (WHERE trim(name) <> '') AS streets
        FROM strip GROUP BY corridor HAVING sum(len) >= 35000),
    whole_piece AS MATERIALIZED (SELECT piece.*, coalesce(names, 'unnamed corridor') AS names, split_part(names, ' - ', 1) AS lead FROM piece LEFT JOIN named USING (corridor)),
    ends AS (SELECT corridor, lead, x0, y0, x1, y1 FROM strip JOIN whole_piece USING (corridor) WHERE lead IS NOT NULL),
    point AS (SELECT DISTINCT corridor, lead, x, y FROM (SELECT corridor, lead, x0 AS x, y0 AS y FROM ends UNION ALL SELECT corridor, lead, x1, y1 FROM ends)),
    near AS (SELECT DISTINCT p.corridor AS a, e.corridor AS b FROM point p JOIN ends e ON p.lead = e.lead AND p.corridor <> e.corridor
             AND pow(p.x - greatest(least(x0, x1), least(greatest(x0, x1), p.x)), 2) + pow(p.y - greatest(least(y0, y1), least(greatest(y0, y1), p.y)), 2) <= 3600000000),
    whole_link AS MATERIALIZED (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT corridor, corridor FROM whole_piece),
    {_parts_sql("whole_part", "whole_link")},
    corridor AS (
        SELECT component AS corridor, count(*) AS n_pieces, sum(n) AS n, sum(length) AS length, round(sum(mean_score * length) / sum(length), 6) AS mean_score, round(sum(total_score), 6) AS total_score, max(pairs) AS pairs, max(span) AS span,
               sum(climb_saved) AS climb_saved, round(sum(mean_grade * length) / sum(length), 6) AS mean_grade, round(max(max_grade), 6) AS max_grade, min(z_min) AS z_min, max(z_max) AS z_max, max(z_max) - min(z_min) AS z_range,
               round(sum(gain_per_km * length) / sum(length), 6) AS gain_per_km, round(sum(low_stress * length) / sum(length), 6) AS low_stress,
               array_to_string(list_sort(list_distinct(flatten(list(streets)))), '; ') AS streets, arg_max(names, (length, -corridor)) AS names
        FROM whole_piece JOIN whole_part ON node = corridor GROUP BY component HAVING sum(length) >= 35000)"""


@query("corridors", f"WITH {_CORRIDORS} SELECT *, row_number() OVER (ORDER BY total_score DESC, corridor) AS rank FROM corridor")
def corridors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corridors(spark, sf_dir)


@query(
    "corridor_names",
    """WITH n AS (SELECT segment, name, count(*) AS n FROM edge WHERE trim(name) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, name) AS r FROM n)
       SELECT segment, string_agg(name, ' - ' ORDER BY r) AS names FROM r WHERE r <= 4 GROUP BY segment""",
)
def corridor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corridors.canonical_names(net.edges(spark, sf_dir).select("segment", "name"), "segment")


@query(
    "gap_bridging",
    f"""WITH core AS MATERIALIZED (SELECT edge_id, u, v FROM edge WHERE cls = 'primary' AND edge_id < 1000000000), free AS (SELECT edge_id, u, v, len FROM edge WHERE edge_id < 1000000000),
    {_bridge_sql(40_000)} SELECT edge_id, u, v FROM (SELECT edge_id FROM core UNION SELECT edge_id FROM bridge) JOIN edge USING (edge_id)""",
)
def gap_bridging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of up to three edges and 400 m between the parts of the network of primary streets."""
    edges = net.edges(spark, sf_dir).where("edge_id < 1000000000").select("edge_id", "u", "v", "len", "cls")
    return corridors.bridged(edges.where("cls = 'primary'").drop("cls"), edges.drop("cls"), most_length=40_000)


@query(
    "jaccard_length",
    """SELECT round(100 * sum(len) FILTER (WHERE walk_ok AND bike_ok) / sum(len) FILTER (WHERE walk_ok OR bike_ok), 6) AS jaccard FROM edge""",
)
def jaccard_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = net.edges(spark, sf_dir)
    return corridors.overlap(edges.where("walk_ok").select("edge_id", "len"), edges.where("bike_ok").select("edge_id", "len"))


@query("gain_per_km", "SELECT round(sum(gain) / (sum(len) / 100000.0::DOUBLE), 6) AS gain_per_km FROM arc WHERE walk")
def gain_per_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.arcs(spark, sf_dir).where("walk").agg(F.round(F.sum("gain") / (F.sum("len") / 100_000), 6).alias("gain_per_km"))


@query(
    "steep_streets",
    """SELECT name, round(100 * max(abs(z_v - z_u) / len), 6) AS steepest, round(100 * max(abs(z_v - z_u) / len) - 12, 6) AS difference, abs(100 * max(abs(z_v - z_u) / len) - 12) <= 5 AS ok FROM edge WHERE len >= 1500 GROUP BY name""",
)
def steep_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steepest reliable grade of each street against a published one of 12 percent, within five points."""
    steep = 100 * F.max(F.abs(F.col("z_v") - F.col("z_u")) / F.col("len"))
    rows = net.edges(spark, sf_dir).where("len >= 1500").groupBy("name").agg(F.round(steep, 6).alias("steepest"), F.round(steep - 12, 6).alias("difference"), (F.abs(steep - 12) <= 5).alias("ok"))
    return rows


@query("flat_streets", "SELECT name, round(sum(len) / 100000.0::DOUBLE, 6) AS km, round(sum(abs(z_v - z_u)) / (sum(len) / 100000.0::DOUBLE) / 100, 6) AS gain_per_km, sum(abs(z_v - z_u)) / (sum(len) / 100000.0::DOUBLE) / 100 < 15 AS flat FROM edge GROUP BY name")
def flat_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = F.sum("len") / 100_000
    per = F.sum(F.abs(F.col("z_v") - F.col("z_u"))) / km / 100
    return net.edges(spark, sf_dir).groupBy("name").agg(F.round(km, 6).alias("km"), F.round(per, 6).alias("gain_per_km"), (per < 15).alias("flat"))


@query("dem_agreement", "WITH d AS (SELECT z - (avg(z) OVER (PARTITION BY row)) AS d FROM node) SELECT round(avg(d), 6) + 0 AS mean, round(median(d), 6) AS median, round(sqrt(avg(d * d)), 6) AS rms, round(avg(CASE WHEN abs(d) < 200 THEN 1.0 ELSE 0 END), 6) AS near FROM d")
def dem_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far heights are from a second model, here the mean of their row."""
    nodes = net.nodes(spark, sf_dir)
    rows = nodes.join(nodes.groupBy("row").agg(F.avg("z").alias("m")), "row").select((F.col("z") - F.col("m")).alias("d"))
    return rows.agg((F.round(F.avg("d"), 6) + 0).alias("mean"), F.round(F.median("d"), 6).alias("median"), F.round(F.sqrt(F.avg(F.col("d") ** 2)), 6).alias("rms"), F.round(F.avg(F.when(F.abs("d") < 200, 1.0).otherwise(0.0)), 6).alias("near"))
