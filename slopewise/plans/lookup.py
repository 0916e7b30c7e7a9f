"""Queries over places, addresses, search, packing and layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopewise.functions import text
from slopewise.operators import packing, paths, places, warp
from slopewise.operators import costs as cost_ops
from slopewise.plans import routing
from slopewise.plans.registry import query
from slopewise.plans.streets import access_points
from slopewise.sources import street_network as net

CITY = "harborview"
SUFFIXES = ("harborview", "harborview wa", "wa", "usa")
CATEGORIES = ("park", "bar", "bike_trail", "art_museum", "office", None)


def place_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for every part: names that add to each other, categories and trust."""
    n = net.nodes(spark, sf_dir)
    k = F.col("node") % 6
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(", Harborview"))).when(k == 2, F.concat("p_name", F.lit(" Cafe"))).when(k == 3, F.concat("p_name", F.lit(" - North/WA")))
    name = name.when(k == 4, F.concat(F.lit("Old "), "p_name", F.lit(" Hall")))
    return n.select(F.col("node").alias("place"), name.alias("name"), net.choose(k, dict(enumerate(CATEGORIES))).alias("category"), (F.col("p_size") / 50).alias("conf"), "x", "y")


_PLACES = """place AS (
    SELECT node AS place, CASE node % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ', Harborview' WHEN 2 THEN p_name || ' Cafe' WHEN 3 THEN p_name || ' - North/WA' WHEN 4 THEN 'Old ' || p_name || ' Hall' END AS name,
           CASE node % 6 WHEN 0 THEN 'park' WHEN 1 THEN 'bar' WHEN 2 THEN 'bike_trail' WHEN 3 THEN 'art_museum' WHEN 4 THEN 'office' END AS category, p_size / 50::DOUBLE AS conf, x, y FROM node),
    kind AS (SELECT *, CASE category WHEN 'park' THEN 'park' WHEN 'bar' THEN 'food' WHEN 'bike_trail' THEN 'landmark' WHEN 'art_museum' THEN 'landmark' END AS grp FROM place)"""
_SUPPORT = f"""{_PLACES},
    supported AS (
        SELECT p.*, (SELECT count(*) FROM place o WHERE abs(o.x - p.x) < 30000 AND abs(o.y - p.y) < 30000 AND contains(lower(o.name), lower(p.name)) AND lower(o.name) <> lower(p.name)) AS support FROM kind p)"""


def _supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = place_table(spark, sf_dir)
    return rows.join(places.support(rows), "place").withColumn("group", text.group_of(F.col("category")))


@query("place_support", f"WITH {_SUPPORT} SELECT place, support FROM supported")
def place_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.support(place_table(spark, sf_dir))


@query("category_groups", f"WITH {_PLACES} SELECT category, grp AS category_group, count(*) AS n FROM kind GROUP BY ALL")
def category_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_table(spark, sf_dir).groupBy("category", text.group_of(F.col("category")).alias("category_group")).agg(F.count(F.lit(1)).alias("n"))


_KEPT = f"{_SUPPORT}, kept AS (SELECT * FROM supported WHERE name IS NOT NULL AND ((length(name) >= 3 AND grp IS NOT NULL AND conf >= 0.6::DOUBLE) OR (category IS NULL AND conf >= 0.9::DOUBLE) OR (support >= 5 AND conf >= 0.6::DOUBLE)))"


@query("place_keep", f"WITH {_KEPT} SELECT place, name FROM kept")
def place_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.keep(_supported(spark, sf_dir)).select("place", "name")


_BEST = f"{_KEPT}, best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY name ORDER BY support DESC, conf DESC, place) = 1)"


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.best_by_name(places.keep(_supported(spark, sf_dir)))


@query("place_best", f"WITH {_BEST} SELECT place, name, support FROM best")
def place_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("place", "name", "support")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of mapped features: one a nation, and what some of the parts are called, with words before."""
    parts = net.table(spark, sf_dir, "part").select(F.concat(F.lit("Great "), "p_name").alias("name")).where("name < 'Great m'")
    return parts.unionByName(net.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))).distinct()


_CORE = r"lower(trim(regexp_replace({0}, '(?i)([\s,\-/]+harborview([\s,]+(wa|washington|usa))?|[,\-/]\s*(wa|washington|usa))\s*$', '')))"


@query("city_suffix", f"WITH {_PLACES} SELECT place, {_CORE.format('name')} AS core FROM place WHERE name IS NOT NULL")
def city_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_table(spark, sf_dir).where("name is not null").select("place", text.core(F.col("name"), CITY).alias("core"))


@query(
    "superseded",
    rf"""WITH {_BEST}, mapped AS (SELECT DISTINCT lower('Great ' || p_name) AS c FROM part WHERE 'Great ' || p_name < 'Great m' UNION SELECT lower(n_name) FROM nation),
            known AS (SELECT c FROM mapped UNION SELECT t FROM (SELECT unnest(list_transform(range(2, len(string_split(c, ' ')) + 1), lambda k: array_to_string(string_split(c, ' ')[k:], ' '))) AS t FROM mapped) WHERE length(t) >= 8)
       SELECT place, name FROM (SELECT *, {_CORE.format('name')} AS c FROM best) WHERE c NOT IN (FROM known) AND regexp_split_to_array(c, '\s*[,\-/(]\s*')[1] NOT IN (FROM known)""",
)
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.superseded(_best(spark, sf_dir).select("place", "name"), _mapped(spark, sf_dir), CITY)


def _variants_sql(rounds: int = 6) -> str:
    """Which of the best places go: what no one is left to take out stays and takes out what it can, round by round."""
    steps = [f"""{_BEST}, v AS MATERIALIZED (SELECT place, name, coalesce(grp, 'landmark') AS grp, support, conf, x, y FROM best),
        longer AS (SELECT v.*, substr(name, 1, k) AS start, lower(trim(substr(name, k + 1), ' ,-/()')) AS added FROM v, unnest(range(1, length(name))) AS t(k) WHERE contains(' ,-/(', substr(name, CAST(k + 1 AS INT), 1))),
        by_0 AS MATERIALIZED (
            SELECT a.place, b.place AS taker FROM longer a JOIN v b ON b.name = a.start AND (-b.support, -b.conf, b.place) < (-a.support, -a.conf, a.place),
                   LATERAL (SELECT CASE WHEN added IN ({", ".join(f"'{s}'" for s in SUFFIXES)}) THEN {places.FAR} WHEN a.grp = b.grp THEN CASE WHEN b.support >= 3 AND a.support = 0 THEN {places.FAR} ELSE {places.NEAR} END END AS reach)
            WHERE abs(a.x - b.x) < reach AND abs(a.y - b.y) < reach)"""]
    for k in range(rounds):
        steps.append(f"out_{k} AS MATERIALIZED (SELECT DISTINCT place FROM by_{k} WHERE taker NOT IN (SELECT place FROM by_{k}))")
        steps.append(f"by_{k + 1} AS MATERIALIZED (SELECT * FROM by_{k} WHERE place NOT IN (FROM out_{k}) AND taker NOT IN (FROM out_{k}))")
    return ", ".join(steps) + ", gone AS (" + " UNION ALL ".join(f"FROM out_{k}" for k in range(rounds)) + ")"


@query("prune_variants", f"WITH {_variants_sql()} SELECT place, name, support FROM v WHERE place NOT IN (FROM gone)")
def prune_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _best(spark, sf_dir).withColumn("group", F.coalesce("group", F.lit("landmark")))
    return places.prune_variants(rows, SUFFIXES).select("place", "name", "support")


@query(
    "base_features",
    "WITH f AS (SELECT p_name AS name, p_type AS kind, p_partkey AS place, p_size * p_size AS area FROM part) SELECT name, kind, place, area FROM f WHERE length(name) >= 3 QUALIFY row_number() OVER (PARTITION BY name, kind ORDER BY area DESC, place) = 1",
)
def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = net.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("place"), (F.col("p_size") * F.col("p_size")).alias("area"))
    first = W.partitionBy("name", "kind").orderBy(F.desc("area"), "place")
    return rows.where("length(name) >= 3").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def address_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address for every order: its customer's number on a street of the customer's nation."""
    w = net.width(spark, sf_dir) * net.CELL
    customers = net.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    k = F.col("c_nationkey") % 4
    street = F.when(k == 0, F.concat(F.col("c_nationkey") + 20, F.lit("TH AVE N"))).when(k == 1, F.concat(F.lit("N  JOHN MUIR"), F.col("c_nationkey").cast("string"), F.lit(" DR"))).when(k == 2, F.concat(F.lit("OAK "), F.col("c_nationkey").cast("string"), F.lit(" ST W"))).otherwise(F.concat(F.lit("ELM LOOP "), F.col("c_nationkey").cast("string")))
    # Merged, as Spark takes the customers to be as small as their compressed file.
    orders = net.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers.hint("merge"), "o_custkey")
    number = F.when(F.col("o_orderkey") % 50 == 0, "A12").when(F.col("o_orderkey") % 51 == 0, "99999 B").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(" 1/2")))
    return orders.select("o_orderkey", number.alias("number"), street.alias("street"), (F.col("o_custkey") * 31 % w).alias("x"), (F.col("o_orderkey") * 17 % w).alias("y"))


_ADDRESS = f"""raw AS (
    SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'A12' WHEN o_orderkey % 51 = 0 THEN '99999 B' ELSE o_custkey || ' 1/2' END AS number,
           CASE c_nationkey % 4 WHEN 0 THEN (c_nationkey + 20) || 'th Ave N' WHEN 1 THEN 'N John Muir' || c_nationkey || ' Dr' WHEN 2 THEN 'Oak ' || c_nationkey || ' St W' ELSE 'Elm Loop ' || c_nationkey END AS street,
           o_custkey * 31 % (w * {net.CELL}) AS x, o_orderkey * 17 % (w * {net.CELL}) AS y FROM orders JOIN customer ON c_custkey = o_custkey, w),
    address AS (SELECT street, CAST(regexp_extract(number, '^(\\d+)', 1) AS BIGINT) AS number, min({{'x': x, 'y': y}}) AS p FROM raw WHERE regexp_matches(number, '^\\d') AND CAST(regexp_extract(number, '^(\\d+)', 1) AS BIGINT) < 65536 GROUP BY ALL)"""


@query("street_title", f"WITH {_ADDRESS} SELECT o_orderkey, street FROM raw")
def street_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_rows(spark, sf_dir).select("o_orderkey", text.title_street(F.col("street")).alias("street"))


@query("leading_number", f"WITH {_ADDRESS} SELECT o_orderkey, CASE WHEN regexp_matches(number, '^\\d') AND CAST(regexp_extract(number, '^(\\d+)', 1) AS BIGINT) < 65536 THEN CAST(regexp_extract(number, '^(\\d+)', 1) AS BIGINT) END AS number FROM raw")
def leading_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_rows(spark, sf_dir).select("o_orderkey", text.leading_number(F.col("number")).alias("number"))


@query("address_index", f"WITH {_ADDRESS} SELECT street, dense_rank() OVER (ORDER BY street) - 1 AS street_no, number, p.x AS x, p.y AS y FROM address")
def address_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.addresses(address_rows(spark, sf_dir))


@query("intersection_index", "WITH n AS (SELECT node, string_agg(DISTINCT name, ' & ' ORDER BY name) AS names, count(DISTINCT name) AS k FROM (SELECT u AS node, name FROM edge UNION ALL SELECT v, name FROM edge) GROUP BY node) SELECT names, min(node) AS node FROM n WHERE k >= 2 GROUP BY names")
def intersection_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.intersections(net.edges(spark, sf_dir))


@query(
    "corner_label",
    """WITH n AS (SELECT node, string_agg(DISTINCT name, ' & ' ORDER BY name) AS names FROM (SELECT u AS node, name FROM edge UNION ALL SELECT v, name FROM edge) GROUP BY node HAVING count(DISTINCT name) >= 2),
            v AS (SELECT c_custkey AS visitor, c_custkey * 7919 % (w * 10000) AS x, c_custkey * 104729 % (w * 10000) AS y FROM customer, w)
       SELECT visitor, names FROM v JOIN node m ON abs(m.x - v.x) <= 15000 AND abs(m.y - v.y) <= 15000 JOIN n ON n.node = m.node WHERE pow(m.x - v.x, 2) + pow(m.y - v.y, 2) <= 225000000
       QUALIFY row_number() OVER (PARTITION BY visitor ORDER BY pow(m.x - v.x, 2) + pow(m.y - v.y, 2), m.node) = 1""",
)
def corner_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest corner of two named streets within 150 m of each customer."""
    from slopewise.operators import spatial
    from slopewise.plans.streets import _visitors

    ends = net.edges(spark, sf_dir).select(F.explode(F.array("u", "v")).alias("node"), "name").groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("parts")).where(F.size("parts") >= 2)
    corners = ends.join(net.nodes(spark, sf_dir).select("node", "x", "y"), "node")
    best = spatial.nearest(_visitors(spark, sf_dir), corners, "visitor", "node", 15_000)
    return best.join(corners, "node").select("visitor", F.array_join("parts", " & ").alias("names"))


@query(
    "match_score",
    f"""WITH {_PLACES}, q AS (SELECT place, replace(replace(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), 'north', 'n'), '  ', ' ') AS n FROM place WHERE name IS NOT NULL), t AS (SELECT place, trim(n) AS n FROM q)
       SELECT place, CASE WHEN n = 'blue bolt' THEN 0 WHEN starts_with(n, 'blue bolt') THEN 1 WHEN contains(' ' || n, ' blue') AND contains(' ' || n, ' bolt') THEN 2 WHEN contains(n, 'blue bolt') THEN 3 ELSE -1 END AS score FROM t""",
)
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = place_table(spark, sf_dir).where("name is not null")
    return rows.select("place", text.match_score(text.normalised(F.col("name")), F.lit("blue bolt")).alias("score"))


@query(
    "search",
    f"""WITH {_BEST}, {_ADDRESS},
            street AS (SELECT street, lower(street) AS n FROM (SELECT DISTINCT street FROM address)),
            near AS (SELECT street, CASE WHEN n = 'oak st' THEN 0 WHEN starts_with(n, 'oak st') THEN 1 WHEN contains(' ' || n, ' oak') AND contains(' ' || n, ' st') THEN 2 ELSE -1 END AS s FROM street),
            four AS (SELECT * FROM near WHERE s BETWEEN 0 AND 2 ORDER BY s, length(street), street LIMIT 4),
            hit AS (SELECT street, s, min({{'off': abs(number - 17), 'number': number}}) AS h FROM address JOIN four USING (street) GROUP BY street, s),
            named AS (SELECT coalesce(grp, 'landmark') AS kind, name, trim(replace(replace(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), 'north', 'n'), '  ', ' ')) AS n FROM best),
            scored AS (SELECT kind, name, CASE WHEN n = '17 oak st' THEN 0 WHEN starts_with(n, '17 oak st') THEN 1 WHEN contains(' ' || n, ' 17') AND contains(' ' || n, ' oak') AND contains(' ' || n, ' st') THEN 2
                                            WHEN contains(n, '17 oak st') THEN 3 WHEN starts_with(replace(n, ' ', ''), '17oakst') THEN 2 ELSE -1 END AS score FROM named),
            found AS (
                SELECT CASE WHEN h.off = 0 THEN -1 ELSE s END AS score, 0 AS rank, CASE WHEN h.off = 0 THEN 'address' ELSE 'nearest address' END AS kind, h.number || ' ' || street AS name FROM hit
                UNION ALL SELECT score, 1 + CASE kind WHEN 'landmark' THEN 1 WHEN 'food' THEN 2 ELSE 0 END, kind, name FROM scored WHERE score >= 0)
       SELECT score, rank, kind, name FROM found QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY score, rank) = 1 ORDER BY score, rank, length(name), name, kind LIMIT 8""",
)
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _best(spark, sf_dir).select("name", F.coalesce("group", F.lit("landmark")).alias("kind"))
    return places.search("17 Oak Street", kinds, places.address_points(address_rows(spark, sf_dir)), places.intersections(net.edges(spark, sf_dir)))


@query("bucketise", "SELECT edge_id, CASE WHEN len >= 12000 THEN 4 WHEN len >= 11000 THEN 3 WHEN len >= 10000 THEN 2 WHEN len >= 9000 THEN 1 ELSE 0 END AS bucket FROM edge")
def bucketise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.edges(spark, sf_dir).select("edge_id", packing.bucket(F.col("len"), (9000, 10_000, 11_000, 12_000)).alias("bucket"))


@query("quantise", "SELECT edge_id, least(65535, greatest(0, CAST(round_even(len * 0.05::DOUBLE, 0) AS BIGINT))) AS q, least(300, greatest(-300, CAST(round_even((z_v - z_u) * 0.25::DOUBLE, 0) AS BIGINT))) AS dz FROM edge")
def quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.edges(spark, sf_dir).select("edge_id", packing.quantise(F.col("len"), 0.05).alias("q"), packing.quantise(F.col("z_v") - F.col("z_u"), 0.25, -300, 300).alias("dz"))


@query("dictionary_index", "SELECT name, row_number() OVER (ORDER BY name) AS number FROM (SELECT DISTINCT name FROM edge WHERE name <> '')")
def dictionary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.dictionary(net.edges(spark, sf_dir), "name")


@query("csr_pointers", "WITH d AS (SELECT n.node, count(a.src) AS degree FROM node n LEFT JOIN arc a ON a.src = n.node GROUP BY n.node) SELECT node, degree, CAST(coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM d")
def csr_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.row_pointers(net.arcs(spark, sf_dir), net.nodes(spark, sf_dir))


@query("delta_code", "SELECT profile, station, ((z - coalesce(lag(z) OVER (PARTITION BY profile ORDER BY station), 0)) % 65536 + 65536) % 65536 AS delta FROM profile")
def delta_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.deltas(net.profiles(spark, sf_dir), "profile", "station", "z")


@query("bit_flags", "SELECT arc_id, CAST(walk AS INT) + 2 * CAST(bike AS INT) + 4 * CAST(direction = 'rev' AS INT) + 8 * CAST(cls <> 'steps' AS INT) AS flags FROM arc")
def bit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.arcs(spark, sf_dir).select("arc_id", packing.bits(F.col("walk"), F.col("bike"), F.col("direction") == "rev", F.col("cls") != "steps").alias("flags"))


@query("encoded_lines")
def encoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile as polyline text."""
    rows = net.profiles(spark, sf_dir).groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("station", F.col("dist").cast("double").alias("x"), (F.col("z") / 100).alias("y")))).alias("p"))
    rows = rows.select("profile", F.col("p.x").alias("x"), F.col("p.y").alias("y"))

    @F.pandas_udf("string")
    def encode(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([packing.encode_line(list(zip(a, b, strict=True))) for a, b in zip(x, y, strict=True)])

    return rows.select("profile", encode("x", "y").alias("line"))


def _layout(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    points = access_points(spark, sf_dir)
    costs = paths.distances(routing.network(spark, sf_dir, "walk", cost_ops.BALANCED), points.select(F.col("node").alias("source"))).join(points.select("node"), "node", "left_semi")
    ids, wanted = warp.cost_matrix(costs.select("source", "node", "cost"))
    place = {r.node: (r.x / 1e5, r.y / 1e5) for r in net.nodes(spark, sf_dir).join(points.select("node"), "node", "left_semi").collect()}
    start = np.array([place[int(i)] for i in ids])
    far = np.sqrt(((start[:, None] - start[None]) ** 2).sum(-1))
    wanted = np.nan_to_num(wanted, nan=float(np.nanmean(wanted)))
    wanted = wanted * (far.sum() / max(wanted.sum(), 1e-12))
    moved, stress = warp.smacof(wanted, start)
    return ids, start, warp.procrustes(moved, start), stress


@query("warp_layout")
def warp_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _, moved, stress = _layout(spark, sf_dir)
    return spark.createDataFrame([(int(i), float(x), float(y), stress) for i, (x, y) in zip(ids, moved, strict=True)], "node long, x double, y double, stress double")


@query("tps_apply")
def tps_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, start, moved, _ = _layout(spark, sf_dir)
    nodes = net.nodes(spark, sf_dir).select("node", (F.col("x") / 1e5).alias("x"), (F.col("y") / 1e5).alias("y"))
    return warp.apply(nodes, start, warp.spline(start, moved), "node")
