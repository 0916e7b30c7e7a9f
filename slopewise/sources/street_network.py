"""The street network that the registered queries run on, derived from the driver's tables.

Every row of `part` is a corner of a grid; streets join it to its right and its
lower neighbour. All lengths and heights are whole centimetres, so that sums are
exact. Neighbourhoods are blocks of the grid, six by six of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.session import table

CELL = 10_000
HOODS = 6
#: Steepness classes in percent, with a column d_above_<k> each.
GRADES = (3, 5, 8, 10, 15)
CLASS_OF = {"STANDARD": "residential", "ECONOMY": "primary", "MEDIUM": "secondary", "PROMO": "footway", "LARGE": "cycleway", "SMALL": "steps"}
PARALLEL = 1_000_000_000


def choose(column: Column, table: dict, default=None) -> Column:
    """CASE column WHEN key THEN value ... ELSE default."""
    out = None
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))


_WIDTHS: dict[tuple[str, str], int] = {}


def width(spark: SparkSession, sf_dir: str) -> int:
    """Corners in a row of the grid; counted once for each session and folder, as the tables do not change."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WIDTHS:
        _WIDTHS[key] = max(1, math.isqrt(table(spark, sf_dir, "part").count()))
    return _WIDTHS[key]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, col, row, x, y, z and the attributes of its part.

    Joins with them are planned by merging: Spark takes a table to be as large as its compressed files, a small part of what it
    holds, and would broadcast all of it.
    """
    w = width(spark, sf_dir)
    block = -(-w // HOODS)
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    grid = part.select(key.alias("node"), (key % w).alias("col"), F.expr(f"p_partkey div {w}").alias("row"), "p_size", "p_type", "p_brand", "p_name")
    return grid.select(
        "*",
        (F.col("col") * CELL).alias("x"),
        (F.col("row") * CELL).alias("y"),
        ((F.col("p_size") * 7 + F.col("node") * 13 % 400) * 10).cast("long").alias("z"),
        F.expr(f"(row div {block}) * 100 + col div {block}").alias("hood"),
    ).hint("merge")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a street piece: ends u and v, length, heights, class and access; its middle lies half the crown above the mean of its ends."""
    w = width(spark, sf_dir)
    a = nodes(spark, sf_dir)
    b = a.select(F.col("node").alias("v"), F.col("z").alias("z_v"), F.col("p_size").alias("size_v"), F.col("row").alias("row_v"))
    start = a.select(
        "*",
        F.explode(
            F.array(
                F.struct((F.col("node") * 2).alias("edge_id"), (F.col("node") + 1).alias("v"), F.concat(F.lit("r"), "row").alias("segment"), F.col("col").alias("part"), F.lit(True).alias("right")),
                F.struct((F.col("node") * 2 + 1).alias("edge_id"), (F.col("node") + w).alias("v"), F.concat(F.lit("c"), "col").alias("segment"), F.col("row").alias("part"), F.lit(False).alias("right")),
            )
        ).alias("e"),
    ).select("*", "e.*")
    joined = start.join(b, "v").where(~F.col("right") | (F.col("row") == F.col("row_v")))
    # Twins come from the same row, as a union would join all corners twice.
    twice = F.when(F.col("edge_id") % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = joined.withColumn("twin", F.explode(twice)).select(
        (F.col("edge_id") + F.col("twin") * PARALLEL).alias("edge_id"), F.col("node").alias("u"), "v", "segment", "part",
        ((8000 + F.col("p_size") * 50 + F.col("size_v") * 30) * (1 + F.col("twin"))).cast("long").alias("len"),
        F.col("z").alias("z_u"), "z_v", choose(F.col("p_type"), CLASS_OF).alias("cls"), F.col("p_brand").alias("name"),
    )
    return both.select(
        "*",
        (F.col("edge_id") % 23 != 0).alias("walk_ok"),
        ((F.col("cls") != "steps") & (F.col("edge_id") % 19 != 0)).alias("bike_ok"),
        (F.col("edge_id") % 11 == 0).alias("bike_oneway"),
        (F.col("edge_id") % 29 == 0).alias("is_structure"),
        (F.col("edge_id") % 31 * 20).alias("crown"),
    )


def edge_of(arc_id: str) -> Column:
    """The edge of an arc of directed, from its number alone."""
    return F.expr(f"{arc_id} div 2")


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed(edges(spark, sf_dir))


def directed(edges: DataFrame) -> DataFrame:
    """Two arcs an edge, forward and reverse, with gain and loss mirrored and the lengths at or above each grade."""
    up, down = F.greatest(F.col("z_v") - F.col("z_u"), F.lit(0)), F.greatest(F.col("z_u") - F.col("z_v"), F.lit(0))
    ways = F.array(
        F.struct((F.col("edge_id") * 2).alias("arc_id"), F.lit("fwd").alias("direction"), F.col("u").alias("src"), F.col("v").alias("dst"), up.alias("gain"), down.alias("loss")),
        F.struct((F.col("edge_id") * 2 + 1).alias("arc_id"), F.lit("rev").alias("direction"), F.col("v").alias("src"), F.col("u").alias("dst"), down.alias("gain"), up.alias("loss")),
    )
    both = edges.withColumn("a", F.explode(ways)).select("a.*", *[c for c in edges.columns if c not in ("u", "v")])
    both = both.withColumns({f"d_above_{k}": F.when(F.col("gain") * 100 >= F.col("len") * k, F.col("len")).otherwise(0) for k in GRADES})
    return both.withColumn("walk", F.col("walk_ok")).withColumn("bike", F.col("bike_ok") & ((F.col("direction") == "fwd") | ~F.col("bike_oneway")))


def hoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hood and its box in centimetres, half a cell wider than its corners on each side."""
    grid = nodes(spark, sf_dir).groupBy("hood").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return grid.select("hood", *[(F.col(c) + d * (CELL // 2)).alias(c) for c, d in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of one profile for each user of `events`: distance in metres, height in whole centimetres."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("profile"), at.cast("long").alias("station"), (at * 5).cast("long").alias("dist"), F.round(F.col("value") * 100).cast("long").alias("z"))


#: The same network for an engine that speaks SQL, as common table expressions.
SQL = f"""
    w AS (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS w FROM part),
    node AS (
        SELECT p_partkey AS node, p_partkey % w AS col, p_partkey // w AS row, p_size, p_type, p_brand, p_name,
               (p_partkey % w) * {CELL} AS x, (p_partkey // w) * {CELL} AS y,
               CAST((p_size * 7 + p_partkey * 13 % 400) * 10 AS BIGINT) AS z,
               ((p_partkey // w) // ((w + {HOODS - 1}) // {HOODS})) * 100 + (p_partkey % w) // ((w + {HOODS - 1}) // {HOODS}) AS hood
        FROM part, w),
    plain AS (
        SELECT 2 * a.node AS edge_id, a.node AS u, b.node AS v, 'r' || a.row AS segment, a.col AS part,
               CAST(8000 + a.p_size * 50 + b.p_size * 30 AS BIGINT) AS len, a.z AS z_u, b.z AS z_v, a.p_type, a.p_brand AS name
        FROM node a JOIN node b ON b.node = a.node + 1 AND a.row = b.row
        UNION ALL
        SELECT 2 * a.node + 1, a.node, b.node, 'c' || a.col, a.row,
               CAST(8000 + a.p_size * 50 + b.p_size * 30 AS BIGINT), a.z, b.z, a.p_type, a.p_brand
        FROM node a JOIN w ON true JOIN node b ON b.node = a.node + w.w),
    twice AS (
        SELECT * FROM plain UNION ALL
        SELECT edge_id + {PARALLEL}, u, v, segment, part, len * 2, z_u, z_v, p_type, name FROM plain WHERE edge_id % 17 = 0),
    edge AS (
        SELECT edge_id, u, v, segment, part, len, z_u, z_v,
               CASE p_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_OF.items())} END AS cls, name,
               edge_id % 23 <> 0 AS walk_ok, p_type <> 'SMALL' AND edge_id % 19 <> 0 AS bike_ok,
               edge_id % 11 = 0 AS bike_oneway, edge_id % 29 = 0 AS is_structure, edge_id % 31 * 20 AS crown
        FROM twice),
    ways AS (
        SELECT edge_id * 2 AS arc_id, 'fwd' AS direction, u AS src, v AS dst,
               greatest(z_v - z_u, 0) AS gain, greatest(z_u - z_v, 0) AS loss, * EXCLUDE (u, v) FROM edge
        UNION ALL
        SELECT edge_id * 2 + 1, 'rev', v, u, greatest(z_u - z_v, 0), greatest(z_v - z_u, 0), * EXCLUDE (u, v) FROM edge),
    arc AS (
        SELECT *, {", ".join(f"CASE WHEN gain * 100 >= len * {k} THEN len ELSE 0 END AS d_above_{k}" for k in GRADES)},
               walk_ok AS walk, bike_ok AND (direction = 'fwd' OR NOT bike_oneway) AS bike
        FROM ways),
    hood AS (
        SELECT hood, min(x) - {CELL // 2} AS x0, min(y) - {CELL // 2} AS y0, max(x) + {CELL // 2} AS x1, max(y) + {CELL // 2} AS y1
        FROM node GROUP BY hood),
    profile AS (
        SELECT user_id AS profile, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS station,
               (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 5 AS dist,
               CAST(round(value * 100) AS BIGINT) AS z
        FROM events)"""
