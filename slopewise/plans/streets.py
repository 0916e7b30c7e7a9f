"""Queries over segments, access rules, pieces and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.functions import geometry
from slopewise.operators import access, runs, sidewalks, spatial
from slopewise.plans.registry import query
from slopewise.session import cut
from slopewise.sources import street_network as net

#: Rule sets of the fixture, as JSON; an edge uses the one of its number modulo their count.
RULE_SETS = (
    "[]",
    '[{"access_type": "denied"}]',
    '[{"access_type": "denied"}, {"access_type": "allowed", "when": {"mode": ["foot"]}}]',
    '[{"access_type": "denied", "when": {"heading": "backward"}}]',
    '[{"access_type": "allowed", "when": {"recognized": ["as_private"]}}]',
    '[{"access_type": "denied", "when": {"during": "Mo-Fr"}}, {"access_type": "denied", "between": [0.2, 0.4]}]',
    '[{"access_type": "designated", "when": {"mode": ["bicycle"]}}, {"access_type": "denied"}]',
    '[{"access_type": "allowed", "between": [0.0, 0.5], "when": {"using": ["as_customer"]}}, {"access_type": "denied", "when": {"mode": ["bicycle"], "heading": "backward"}}]',
)
#: What the rule sets mean, worked out by hand: (allowed, oneway, restricted, partial) for walking and for cycling.
WALK_MEANS = ("true,false,false,false", "false,false,false,false", "true,false,false,false", "true,true,false,false", "false,false,true,false", "true,false,false,true", "false,false,false,false", "true,false,true,false")
BIKE_MEANS = ("true,false,false,false", "false,false,false,false", "false,false,false,false", "true,true,false,false", "false,false,true,false", "true,false,false,true", "true,false,false,false", "true,true,true,false")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("edge_id")
    return net.edges(spark, sf_dir).select(
        "edge_id",
        F.when(e % 37 == 0, "rail").otherwise("road").alias("subtype"),
        F.when(e % 13 == 0, "motorway").when(e % 10 == 3, None).otherwise(F.col("cls")).alias("class"),
        F.when(e % 6 == 1, "sidewalk").when(e % 6 == 2, "alley").alias("subclass"),
        F.when(e % 5 != 0, F.array(F.struct(F.array(F.lit("is_bridge")).alias("values")), F.struct(F.when(e % 31 == 0, F.array(F.lit("is_abandoned"))).alias("values")))).alias("road_flags"),
        F.from_json(net.choose(e % len(RULE_SETS), dict(enumerate(RULE_SETS))), access.RULES).alias("rules"),
    )


@query(
    "base_filter",
    """SELECT edge_id, coalesce(CASE WHEN edge_id % 13 = 0 THEN 'motorway' WHEN edge_id % 10 = 3 THEN NULL ELSE cls END, 'unknown') AS class
       FROM edge WHERE edge_id % 37 <> 0 AND edge_id % 13 <> 0 AND edge_id % 6 <> 1 AND NOT (edge_id % 31 = 0 AND edge_id % 5 <> 0)""",
)
def base_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.base_filter(segments(spark, sf_dir)).select("edge_id", "class")


@query("segment_flags", "SELECT CASE WHEN edge_id % 5 = 0 THEN '' WHEN edge_id % 31 = 0 THEN 'is_bridge,is_abandoned' ELSE 'is_bridge' END AS flags, count(*) AS n FROM edge GROUP BY 1")
def segment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).groupBy(F.array_join(access.flags(F.col("road_flags")), ",").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


def _access(mode: str, means: tuple[str, ...]):
    values = ", ".join(f"({i}, {m})" for i, m in enumerate(means))

    @query(f"access_{mode}", f"SELECT edge_id, m.allowed, m.oneway, m.restricted, m.partial FROM edge JOIN (VALUES {values}) AS m(i, allowed, oneway, restricted, partial) ON edge_id % {len(means)} = i")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return segments(spark, sf_dir).select("edge_id", access.access(F.col("rules"), mode).alias("a")).select("edge_id", "a.*")


_access("walk", WALK_MEANS)
_access("bike", BIKE_MEANS)


@query("class_eligibility", "SELECT cls, cls <> 'motorway' AS walk_open, cls NOT IN ('steps', 'bridleway') AS bike_open, count(*) AS n, CAST(sum(len) AS BIGINT) AS len FROM edge GROUP BY ALL")
def class_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = net.edges(spark, sf_dir).groupBy("cls", access.class_open(F.col("cls"), "walk").alias("walk_open"), access.class_open(F.col("cls"), "bike").alias("bike_open"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"))


@query(
    "bike_facility",
    """SELECT edge_id, CASE WHEN cls = 'cycleway' THEN 'dedicated_cycleway' WHEN cls = 'footway' AND bike_ok THEN 'shared_path' ELSE '' END AS facility,
              cls IN ('cycleway', 'residential') OR (cls = 'footway' AND bike_ok) AS low_stress FROM edge""",
)
def bike_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = net.edges(spark, sf_dir).select("edge_id", "cls", access.bike_facility(F.col("cls"), F.col("bike_ok")).alias("facility"))
    return rows.select("edge_id", "facility", access.low_stress(F.col("cls"), F.col("facility")).alias("low_stress"))


@query(
    "bike_stress",
    """WITH s AS (SELECT edge_id, CASE cls WHEN 'residential' THEN 1.0 WHEN 'primary' THEN 1.6 WHEN 'secondary' THEN 1.4 WHEN 'footway' THEN 1.3 WHEN 'cycleway' THEN 0.8 ELSE 1.1 END::DOUBLE AS street,
                     edge_id % 7 AS f FROM edge)
       SELECT edge_id, round(CASE f WHEN 1 THEN greatest(0.9::DOUBLE, least(street, 1.2::DOUBLE) * 0.95::DOUBLE) WHEN 0 THEN street
                             ELSE least(street, [9, 0.9, 1.0, 0.9, 0.8, 0.8][CAST(f AS INT)]::DOUBLE) END, 6) AS stress FROM s""",
)
def bike_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    facility = net.choose(F.col("edge_id") % 7, dict(enumerate(access.FACILITIES)))
    return net.edges(spark, sf_dir).select("edge_id", F.round(access.bike_stress(F.col("cls"), facility), 6).alias("stress"))


@query(
    "facility_codes",
    """SELECT edge_id, CASE edge_id % 9 WHEN 0 THEN 'path' WHEN 1 THEN 'path' WHEN 2 THEN 'separated' WHEN 3 THEN 'buffered_lane' WHEN 4 THEN 'lane'
              WHEN 5 THEN 'lane' WHEN 6 THEN 'neighborway' WHEN 7 THEN 'route' ELSE '' END AS facility FROM edge""",
)
def facility_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = net.choose(F.col("edge_id") % 9, dict(enumerate([*map(str.lower, access.FACILITY_OF), "other"])))
    return net.edges(spark, sf_dir).select("edge_id", net.choose(F.upper(category), access.FACILITY_OF, "").alias("facility"))


@query(
    "split_at_connectors",
    """WITH n AS (SELECT segment, max(part) + 1 AS k FROM plain GROUP BY segment),
            c AS (SELECT segment, k, i, i / k::DOUBLE AS f, segment || ':' || i AS id FROM n, unnest(range(k)) AS t(i) WHERE i % 3 <> 0
                  UNION ALL SELECT segment, k, -1, 0.0, 'synth:' || segment || ':start' FROM n UNION ALL SELECT segment, k, k + 1, 1.0, 'synth:' || segment || ':end' FROM n),
            s AS (SELECT segment, row_number() OVER o - 1 AS part, id AS u, lead(id) OVER o AS v, f AS a, lead(f) OVER o AS b FROM c WINDOW o AS (PARTITION BY segment ORDER BY f))
       SELECT segment AS segment_id, part, u, v, a, b FROM s WHERE v IS NOT NULL""",
)
def split_at_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = net.edges(spark, sf_dir).groupBy("segment").agg((F.max("part") + 1).alias("k"))
    stop = lambda i: F.struct(F.concat(F.col("segment"), F.lit(":"), i).alias("connector_id"), (i / F.col("k")).alias("at"))
    placed = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: i % 3 != 0), stop)
    return runs.split_at_connectors(counts.select(F.col("segment").alias("segment_id"), placed.alias("connectors")))


def _comb(edges: DataFrame) -> DataFrame:
    """All streets that run along rows, and the first street that runs down: corners that pass through, and some that do not."""
    return edges.where("(segment like 'r%' or segment = 'c0') and edge_id < 1000000000").select("segment", "part", "u", "v", "len")


@query(
    "merge_pass_through",
    """WITH e AS (SELECT segment, part, u, v, len FROM plain WHERE segment LIKE 'r%' OR segment = 'c0'),
            d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node),
            j AS (SELECT e.*, sum(CASE WHEN lag_v = u AND degree = 2 THEN 0 ELSE 1 END) OVER (PARTITION BY segment ORDER BY part) AS run
                  FROM (SELECT e.*, lag(v) OVER (PARTITION BY segment ORDER BY part) AS lag_v, degree FROM e JOIN d ON d.node = e.u) e)
       SELECT segment, min(part) AS part, arg_min(u, part) AS u, arg_max(v, part) AS v, CAST(sum(len) AS BIGINT) AS len, count(*) AS pieces FROM j GROUP BY segment, run""",
)
def merge_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.merge_pass_through(_comb(net.edges(spark, sf_dir)))


@query("node_degrees", "SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edge UNION ALL SELECT v FROM edge) GROUP BY node")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.degrees(net.edges(spark, sf_dir))


@query(
    "contiguous_runs",
    """SELECT segment, min(part) AS first_part, max(part) AS last_part, count(*) AS n
       FROM (SELECT segment, part, part - row_number() OVER (PARTITION BY segment ORDER BY part) AS island FROM (SELECT DISTINCT segment, part FROM edge WHERE walk_ok)) GROUP BY segment, island""",
)
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.contiguous_runs(net.edges(spark, sf_dir).where("walk_ok"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = net.profiles(spark, sf_dir).groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("station", F.col("dist").cast("double").alias("x"), (F.col("z") / 100).alias("y")))).alias("p"))
    return points.select("profile", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line")).where(F.size("line") > 1)


@query(
    "polyline_length",
    """WITH l AS (SELECT profile, sqrt(pow(dist - lag(dist) OVER o, 2) + pow((z - lag(z) OVER o) / 100.0::DOUBLE, 2)) AS leg FROM profile WINDOW o AS (PARTITION BY profile ORDER BY station))
       SELECT profile, round(sum(leg), 5) AS length FROM l GROUP BY profile HAVING count(*) > 1""",
)
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("profile", F.round(geometry.length(F.col("line")), 5).alias("length"))


@query(
    "midpoint",
    """WITH l AS (SELECT profile, station, dist, z, dist - lag(dist) OVER o AS dx, (z - lag(z) OVER o) / 100.0::DOUBLE AS dy FROM profile WINDOW o AS (PARTITION BY profile ORDER BY station)),
            c AS (SELECT *, sqrt(dx * dx + dy * dy) AS leg, sum(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY profile ORDER BY station) AS upto,
                         sum(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY profile) / 2 AS half FROM l WHERE dx IS NOT NULL)
       SELECT profile, round(dist - dx + dx * (half - (upto - leg)) / leg, 4) AS x, round(z / 100.0::DOUBLE - dy + dy * (half - (upto - leg)) / leg, 4) AS y
       FROM c WHERE upto >= half QUALIFY row_number() OVER (PARTITION BY profile ORDER BY station) = 1""",
)
def midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("half", geometry.length(F.col("line")) / 2)
    rows = rows.select("profile", geometry.along(F.col("line"), F.col("half")).alias("m"), F.size("line"), F.col("half") + 0)
    return rows.select("profile", F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"))


@query(
    "densify_points",
    """WITH n AS (SELECT edge_id, len / 100.0::DOUBLE AS length, greatest(3, CAST(ceil(len / 100.0::DOUBLE / 5) AS INT) + 1) AS n FROM edge)
       SELECT edge_id, n AS samples, round(list_sum(list_transform(range(n), lambda i: length * i / (n - 1))), 4) AS total, round(length / (n - 1), 6) AS step FROM n""",
)
def densify_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = net.edges(spark, sf_dir).select("edge_id", geometry.densify(F.col("len") / 100).alias("at"))
    return rows.select("edge_id", F.size("at").alias("samples"), F.round(F.aggregate("at", F.lit(0.0), lambda s, d: s + d), 4).alias("total"), F.round(F.get("at", F.lit(1)), 6).alias("step"))


@query("morton_key", "SELECT node, CAST(list_sum(list_transform(range(16), lambda i: (((col >> i) & 1) << (2 * i)) + (((row >> i) & 1) << (2 * i + 1)))) AS BIGINT) AS zkey FROM node")
def morton_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.nodes(spark, sf_dir).select("node", geometry.morton(F.col("col"), F.col("row")).alias("zkey"))


def _middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = net.nodes(spark, sf_dir).select(F.col("node").alias("u"), "x", "y")
    right = F.when(F.col("segment").startswith("r"), 1).otherwise(0)
    half = net.CELL // 2
    return net.edges(spark, sf_dir).join(place, "u").select("edge_id", "name", "len", (F.col("x") + right * half).alias("x"), (F.col("y") + (1 - right) * half).alias("y"))


_MIDDLE = f"middle AS (SELECT edge_id, e.name, len, x + CASE WHEN segment LIKE 'r%' THEN {net.CELL // 2} ELSE 0 END AS x, y + CASE WHEN segment LIKE 'r%' THEN 0 ELSE {net.CELL // 2} END AS y FROM edge e JOIN node ON node = u)"


@query("hood_label_left", f"WITH {_MIDDLE} SELECT edge_id, min(hood) AS hood FROM middle m LEFT JOIN hood h ON m.x BETWEEN h.x0 AND h.x1 AND m.y BETWEEN h.y0 AND h.y1 GROUP BY edge_id")
def hood_label_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _middles(spark, sf_dir).select("edge_id", "x", "y")
    return spatial.label_points(points, net.hoods(spark, sf_dir), "hood", net.CELL * 4).select("edge_id", "hood")


@query(
    "hood_intersect_names",
    """WITH s AS (SELECT segment, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM (SELECT segment, u AS node FROM edge UNION ALL SELECT segment, v FROM edge) JOIN node USING (node) GROUP BY segment)
       SELECT segment, string_agg(DISTINCT CAST(hood AS VARCHAR), '; ' ORDER BY CAST(hood AS VARCHAR)) AS names
       FROM s JOIN hood h ON s.x0 <= h.x1 AND h.x0 <= s.x1 AND s.y0 <= h.y1 AND h.y0 <= s.y1 GROUP BY segment""",
)
def hood_intersect_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = net.nodes(spark, sf_dir).select("node", "x", "y")
    ends = net.edges(spark, sf_dir).select("segment", F.explode(F.array("u", "v")).alias("node")).join(places, "node")
    lines = ends.groupBy("segment").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return spatial.polygon_names(lines, net.hoods(spark, sf_dir), "segment", "hood", net.CELL * 8)


@query(
    "corridor_endpoints",
    """WITH e AS (SELECT DISTINCT name, node, x, y FROM (SELECT name, u AS node FROM edge UNION ALL SELECT name, v FROM edge) JOIN node USING (node))
       SELECT a.name, max((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE AS d2 FROM e a JOIN e b ON a.name = b.name AND a.node < b.node GROUP BY a.name""",
)
def corridor_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = net.nodes(spark, sf_dir).select("node", "x", "y")
    ends = net.edges(spark, sf_dir).select("name", F.explode(F.array("u", "v")).alias("node")).join(places, "node")
    return spatial.farthest_ends(ends, "name").select("name", "d2")


def _visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for every customer, on and around the grid."""
    w, key = net.width(spark, sf_dir) * net.CELL, F.col("c_custkey")
    return net.table(spark, sf_dir, "customer").select(key.alias("visitor"), (key * 7919 % w).alias("x"), (key * 104729 % w).alias("y"))


_VISITOR = f"visitor AS (SELECT c_custkey AS visitor, c_custkey * 7919 % (w * {net.CELL}) AS x, c_custkey * 104729 % (w * {net.CELL}) AS y FROM customer, w)"


@query(
    "nearest_node_30m",
    f"""WITH {_VISITOR}, d AS (SELECT visitor, node, pow(v.x - n.x, 2) + pow(v.y - n.y, 2) AS d2 FROM visitor v JOIN node n ON abs(v.x - n.x) <= 3000 AND abs(v.y - n.y) <= 3000)
        SELECT visitor, node, d2 FROM d WHERE d2 <= 9000000 QUALIFY row_number() OVER (PARTITION BY visitor ORDER BY d2, node) = 1""",
)
def nearest_node_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(_visitors(spark, sf_dir), net.nodes(spark, sf_dir), "visitor", "node", 3000)


@query(
    "snap_corner_60m",
    f"""WITH {_VISITOR}, d AS (SELECT visitor, node, pow(v.x - n.x, 2) + pow(v.y - n.y, 2) AS d2, p_type <> 'SMALL' AS corner FROM visitor v, node n),
            c AS (SELECT visitor, node FROM d WHERE corner AND d2 <= 36000000 QUALIFY row_number() OVER (PARTITION BY visitor ORDER BY d2, node) = 1),
            a AS (SELECT visitor, node FROM d QUALIFY row_number() OVER (PARTITION BY visitor ORDER BY d2, node) = 1)
        SELECT a.visitor, coalesce(c.node, a.node) AS node, CASE WHEN c.node IS NULL THEN 'node' ELSE 'corner' END AS kind FROM a LEFT JOIN c USING (visitor)""",
)
def snap_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = net.nodes(spark, sf_dir)
    return spatial.snap(_visitors(spark, sf_dir), nodes.where("p_type <> 'SMALL'"), nodes, "visitor", "node", 6000)


@query(
    "conflate_bikeways",
    f"""WITH f AS (SELECT edge_id AS bikeway, 1 + edge_id % 6 AS rank, segment LIKE 'r%' AS across, x, y FROM (SELECT edge_id, segment, u FROM edge WHERE cls = 'cycleway') JOIN node ON node = u),
            s AS (SELECT edge_id, segment LIKE 'r%' AS across, i, x + CASE WHEN segment LIKE 'r%' THEN i * 1000 ELSE 400 END AS x, y + CASE WHEN segment LIKE 'r%' THEN 400 ELSE i * 1000 END AS y
                  FROM edge JOIN node ON node = u, unnest(range(11)) AS t(i)),
            p AS (SELECT edge_id, s.i, max(rank) AS best FROM s LEFT JOIN f ON s.across = f.across
                  AND CASE WHEN s.across THEN abs(s.y - f.y) <= 1200 AND s.x BETWEEN f.x - 1200 AND f.x + {net.CELL + 1200} ELSE abs(s.x - f.x) <= 1200 AND s.y BETWEEN f.y - 1200 AND f.y + {net.CELL + 1200} END
                  GROUP BY ALL)
        SELECT edge_id, CASE WHEN count(best) * 2 >= count(*) THEN max(best) ELSE 0 END AS rank FROM p GROUP BY edge_id""",
)
def conflate_bikeways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples each edge, beside which it lies by 4 m, every 10 m; bikeways within 12 m that run alike give it their rank if half the samples see one."""
    place = net.nodes(spark, sf_dir).select(F.col("node").alias("u"), "x", "y")
    rows = net.edges(spark, sf_dir).join(place, "u").withColumn("across", F.col("segment").startswith("r"))
    bike = rows.where("cls = 'cycleway'").select("across", (1 + F.col("edge_id") % 6).alias("rank"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    reach, cell = 1200, net.CELL
    # A bikeway is posted in the cells that its reach touches; a sample looks in its own.
    end_x, end_y = F.col("fx") + F.when(F.col("across"), cell).otherwise(0), F.col("fy") + F.when(F.col("across"), 0).otherwise(cell)
    posted = bike.withColumn("cx", F.explode(F.sequence(F.floor((F.col("fx") - reach) / cell), F.floor((end_x + reach) / cell))))
    posted = posted.withColumn("cy", F.explode(F.sequence(F.floor((F.col("fy") - reach) / cell), F.floor((end_y + reach) / cell))))
    i = F.col("i")
    samples = rows.select("edge_id", "across", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"))
    samples = samples.select("edge_id", "across", "i", (F.col("x") + F.when(F.col("across"), i * 1000).otherwise(400)).alias("sx"), (F.col("y") + F.when(F.col("across"), 400).otherwise(i * 1000)).alias("sy"))
    samples = samples.withColumn("cx", F.floor(F.col("sx") / cell)).withColumn("cy", F.floor(F.col("sy") / cell))
    dx, dy = F.col("sx") - F.col("fx"), F.col("sy") - F.col("fy")
    beside = F.when(F.col("across"), (F.abs(dy) <= reach) & dx.between(-reach, cell + reach)).otherwise((F.abs(dx) <= reach) & dy.between(-reach, cell + reach))
    seen = samples.join(posted, ["across", "cx", "cy"]).where(beside).groupBy("edge_id", "i").agg(F.max("rank").alias("best"))
    hits = seen.groupBy("edge_id").agg(F.count(F.lit(1)).alias("hits"), F.max("best").alias("best"))
    return net.edges(spark, sf_dir).select("edge_id").join(hits, "edge_id", "left").select("edge_id", F.when(F.col("hits") * 2 >= 11, F.col("best")).otherwise(0).alias("rank"))


@query(
    "directed_explode",
    "SELECT arc_id, edge_id, direction, src, dst, len, gain, loss, d_above_3, d_above_5, d_above_8, d_above_10, d_above_15 FROM arc",
)
def directed_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.arcs(spark, sf_dir).select("arc_id", "edge_id", "direction", "src", "dst", "len", "gain", "loss", *[f"d_above_{k}" for k in net.GRADES])


@query("traversable", "SELECT direction, cls, count(*) FILTER (WHERE walk) AS walk, count(*) FILTER (WHERE bike) AS bike FROM arc GROUP BY ALL")
def traversable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.arcs(spark, sf_dir).groupBy("direction", "cls").agg(F.count_if("walk").alias("walk"), F.count_if("bike").alias("bike"))


@query(
    "node_table",
    """SELECT node, count(*) AS degree, CAST(sum(len) AS BIGINT) AS len, bool_or(cls IN ('residential', 'secondary')) AS good, bool_or(coalesce(name, '') <> '') AS named
       FROM (SELECT u AS node, len, cls, name FROM edge UNION ALL SELECT v, len, cls, name FROM edge) GROUP BY node""",
)
def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_facts(net.edges(spark, sf_dir))


def node_facts(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "len", "cls", "name")
    return ends.groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("len").alias("len"), F.max(F.col("cls").isin("residential", "secondary")).alias("good"), F.max(F.coalesce("name", F.lit("")) != "").alias("named")
    )


_FACTS = """fact AS (SELECT node, count(*) AS degree, sum(len) AS len, bool_or(cls IN ('residential', 'secondary')) AS good, bool_or(coalesce(name, '') <> '') AS named
    FROM (SELECT u AS node, len, cls, name FROM edge UNION ALL SELECT v, len, cls, name FROM edge) GROUP BY node),
    placed AS (SELECT hood, node, x, y, len, CASE WHEN degree >= 3 AND good AND named THEN 1 WHEN degree >= 3 AND good THEN 2 WHEN good THEN 3 WHEN degree >= 3 THEN 4 ELSE 5 END AS tier FROM fact JOIN node USING (node)),
    centre AS (SELECT hood, sum(x * len) / sum(len)::DOUBLE AS cx, sum(y * len) / sum(len)::DOUBLE AS cy FROM placed GROUP BY hood),
    access_point AS (SELECT hood, node FROM placed JOIN centre USING (hood) QUALIFY row_number() OVER (PARTITION BY hood ORDER BY tier, round(pow(x - cx, 2) + pow(y - cy, 2), 3), node) = 1)"""


def access_points(spark: SparkSession, sf_dir: str, rank: int = 0) -> DataFrame:
    """The node that stands for each neighbourhood: of the first tier that has any, the nearest to the centre of its streets; with a rank a later choice, or the last one."""
    from pyspark.sql import Window as W

    facts = node_facts(net.edges(spark, sf_dir)).join(net.nodes(spark, sf_dir).select("node", "hood", "x", "y"), "node")
    tier = F.when((F.col("degree") >= 3) & F.col("good") & F.col("named"), 1).when((F.col("degree") >= 3) & F.col("good"), 2).when(F.col("good"), 3).when(F.col("degree") >= 3, 4).otherwise(5)
    facts = cut(facts.select("hood", "node", "x", "y", "len", tier.alias("tier")))  # read twice
    centre = facts.groupBy("hood").agg((F.sum(F.col("x") * F.col("len")) / F.sum("len")).alias("cx"), (F.sum(F.col("y") * F.col("len")) / F.sum("len")).alias("cy"))
    far = F.round((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2, 3)
    # There are HOODS squared centres at most. A bound on the row number alone lets each task drop the rest before the exchange.
    ranked = facts.join(F.broadcast(centre), "hood").withColumn("r", F.row_number().over(W.partitionBy("hood").orderBy("tier", far, "node")))
    return ranked.where(F.col("r") <= rank + 1).groupBy("hood").agg(F.max_by("node", "r").alias("node"))


@query("access_points", f"WITH {_FACTS} SELECT hood, node FROM access_point")
def access_points_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_points(spark, sf_dir)


def _straight(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = net.nodes(spark, sf_dir).select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    edges = net.edges(spark, sf_dir).join(place.selectExpr("node as u", "x as x0", "y as y0"), "u").join(place.selectExpr("node as v", "x as x1", "y as y1"), "v")
    return edges.select("edge_id", "u", "v", "len", "cls", "segment", "x0", "y0", "x1", "y1")


def _beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge again, 8 m beside itself, with a number of its own."""
    across = F.col("segment").startswith("r")
    moved = {c: F.col(c) + F.when(across, 0).otherwise(800) for c in ("x0", "x1")} | {c: F.col(c) + F.when(across, 800).otherwise(0) for c in ("y0", "y1")}
    return _straight(spark, sf_dir).withColumns(moved).withColumn("edge_id", -F.col("edge_id") - 1)


@query(
    "nearest_street_12m",
    f"""WITH line AS (SELECT e.edge_id, e.cls, segment LIKE 'r%' AS across, a.x AS x0, a.y AS y0 FROM edge e JOIN node a ON a.node = e.u),
            probe AS (SELECT -edge_id - 1 AS edge_id, across, f, x0 + CASE WHEN across THEN f * {net.CELL} ELSE 800 END AS px, y0 + CASE WHEN across THEN 800 ELSE f * {net.CELL} END AS py FROM line, (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)) AS t(f)),
            near AS (SELECT p.edge_id, p.f, s.across = p.across AS alike,
                            round(CASE WHEN s.across THEN sqrt(pow(p.py - s.y0, 2) + pow(p.px - greatest(s.x0, least(s.x0 + {net.CELL}, p.px)), 2)) ELSE sqrt(pow(p.px - s.x0, 2) + pow(p.py - greatest(s.y0, least(s.y0 + {net.CELL}, p.py)), 2)) END, 6) AS gap
                     FROM probe p JOIN line s ON s.cls <> 'footway' AND s.x0 BETWEEN p.px - {net.CELL + 1200} AND p.px + 1200 AND s.y0 BETWEEN p.py - {net.CELL + 1200} AND p.py + 1200),
            best AS (SELECT edge_id, f, arg_min(alike, gap * 10 + CASE WHEN alike THEN 0 ELSE 1e-7 END) AS alike FROM near WHERE gap <= 1200 GROUP BY ALL)
       SELECT l.edge_id, count(b.f) AS near, count(*) FILTER (WHERE b.alike) AS parallel FROM (SELECT -edge_id - 1 AS edge_id FROM line) l LEFT JOIN best b USING (edge_id) GROUP BY l.edge_id""",
)
def nearest_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidewalks.probe_hits(_beside(spark, sf_dir).select("edge_id", "x0", "y0", "x1", "y1"), _straight(spark, sf_dir).where("cls <> 'footway'").select("edge_id", "x0", "y0", "x1", "y1"), offset=1200.0)


@query(
    "sidewalk_stubs",
    """WITH e AS MATERIALIZED (SELECT edge_id, u, v, cls IN ('steps', 'footway') AS stub FROM edge WHERE walk_ok AND cls <> 'cycleway'),
            dead(edge_id) USING KEY (edge_id) AS (
                SELECT DISTINCT edge_id FROM e JOIN (SELECT n FROM (SELECT u AS n FROM e UNION ALL SELECT v FROM e) GROUP BY n HAVING count(*) = 1) d ON d.n = e.u OR d.n = e.v WHERE stub
                UNION
                SELECT DISTINCT a.edge_id FROM (SELECT e.* FROM e ANTI JOIN recurring.dead r ON r.edge_id = e.edge_id) a
                JOIN (SELECT n FROM (SELECT u AS n FROM e ANTI JOIN recurring.dead r ON r.edge_id = e.edge_id UNION ALL SELECT v FROM e ANTI JOIN recurring.dead r ON r.edge_id = e.edge_id) GROUP BY n HAVING count(*) = 1) d ON d.n = a.u OR d.n = a.v
                WHERE a.stub AND EXISTS (SELECT 1 FROM dead))
       SELECT edge_id, u, v FROM e ANTI JOIN dead USING (edge_id)""",
)
def sidewalk_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walkable network without dead-end steps and footways."""
    edges = net.edges(spark, sf_dir).where("walk_ok and cls <> 'cycleway'").select("edge_id", "u", "v", "cls")
    return sidewalks.prune_stubs(edges.drop("cls"), edges.where("cls in ('steps', 'footway')"))


@query("sidewalk_reconnect")
def sidewalk_reconnect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footways that join what the streets without them leave apart."""
    edges = net.edges(spark, sf_dir).select("edge_id", "u", "v", "len", "cls")
    return sidewalks.reconnect(edges.where("cls in ('primary', 'residential')"), edges.where("cls = 'footway'"))
