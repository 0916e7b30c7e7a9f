"""Map layers of the results, and the lines and labels that they are made of."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.functions import geometry
from slopewise.operators import corridors as corridor_ops
from slopewise.operators import costs
from slopewise.plans import build, extras, routing, streets, terrain
from slopewise.plans.registry import query
from slopewise.session import cut
from slopewise.sources import files
from slopewise.sources import street_network as net

#: Where the grid's first corner lies on the plane of geometry.transverse_mercator, in metres.
ORIGIN = 548_000.0, 5_270_000.0


def merge_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, lines): the pieces (u, v, line) of each key joined to as few lines as can be, through nodes where two of them meet.

    A line is an array of points, lines of a key are in the order of their
    smallest end. Rings begin at their smallest node. A key's pieces are in
    memory together, which are those of a corridor or a street.
    """
    schema = rows.schema

    def join(g: pd.DataFrame) -> pd.DataFrame:
        at: dict[int, list[int]] = {}
        u, v, line = g["u"].tolist(), g["v"].tolist(), [[tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in x] for x in g["line"]]
        for k, ends in enumerate(zip(u, v, strict=True)):
            for node in ends:
                at.setdefault(node, []).append(k)
        free, out = set(range(len(u))), []
        # From ends and forks first; what is left then are rings.
        for start in [n for n in sorted(at) if len(at[n]) != 2] + sorted(at):
            while own := [k for k in at[start] if k in free]:
                node, points, k = start, [], min(own)
                while k is not None:
                    free.discard(k)
                    way = line[k] if u[k] == node else line[k][::-1]
                    points += way if not points else way[1:]
                    node = v[k] if u[k] == node else u[k]
                    k = next((j for j in at[node] if j in free), None) if len(at[node]) == 2 and node != start else None
                out.append([{"x": float(x), "y": float(y)} for x, y in points])
        return pd.DataFrame({key: [g[key].iloc[0]], "lines": [out]})

    return rows.groupBy(key).applyInPandas(join, f"`{key}` {schema[key].dataType.simpleString()}, lines array<array<struct<x: double, y: double>>>")


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, u, v, line) in grid centimetres."""
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return streets._straight(spark, sf_dir).select("edge_id", "u", "v", F.array(point("x0", "y0"), point("x1", "y1")).alias("line"))


@query(
    "merged_lines",
    f"""WITH e AS (SELECT segment, part, part - row_number() OVER (PARTITION BY segment ORDER BY part) AS island FROM edge WHERE walk_ok AND edge_id < {net.PARALLEL})
        SELECT segment, count(DISTINCT island) AS lines, count(*) + count(DISTINCT island) AS points FROM e GROUP BY segment""",
)
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines, and points of them, each street is that one can walk."""
    rows = net.edges(spark, sf_dir).where(f"walk_ok and edge_id < {net.PARALLEL}").select("edge_id", "segment").join(edge_lines(spark, sf_dir), "edge_id")
    merged = merge_lines(rows.select("segment", "u", "v", "line"), "segment")
    return merged.select("segment", F.size("lines").cast("long").alias("lines"), F.aggregate("lines", F.lit(0), lambda n, x: n + F.size(x)).cast("long").alias("points"))


@query("default_trip", f"WITH {routing._COMPARED} SELECT origin, destination, saved_pct FROM (SELECT request // 1000 AS origin, request % 1000 AS destination, saved_pct FROM compared WHERE objective = 'balanced' AND detour_ratio <= 1.35::DOUBLE) ORDER BY saved_pct DESC, origin, destination LIMIT 1")
def default_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trip shown first: of those that the balanced route makes at most 35 percent longer, that which saves most of the climb."""
    solved = routing.trips(spark, sf_dir, objectives=(costs.SHORTEST, costs.BALANCED))  # the others have no part in it
    rows = routing._compared(spark, sf_dir, solved).where("objective = 'balanced' and detour_ratio <= 1.35")
    return rows.orderBy(F.desc("saved_pct"), "origin", "destination").limit(1).select("origin", "destination", "saved_pct")


@query("hood_labels", "SELECT hood, 'Hood ' || hood AS label, (x0 + x1) / 2.0::DOUBLE AS x, (y0 + y1) / 2.0::DOUBLE AS y FROM hood")
def hood_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each neighbourhood and a point inside of it where it is written."""
    at = geometry.representative(geometry.repaired(F.col("ring")))
    return build.polygons(spark, sf_dir).select("hood", F.concat(F.lit("Hood "), F.col("hood").cast("string")).alias("label"), at.alias("p")).select("hood", "label", "p.x", "p.y")


@query("projection_round_trip", "SELECT node, round(-122.3::DOUBLE + (node * 37 % 1000) / 5000.0::DOUBLE, 7) AS lon, round(47.6::DOUBLE + (node * 91 % 1000) / 5000.0::DOUBLE, 7) AS lat FROM node")
def projection_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geographic places projected to the plane and back."""
    node = F.col("node")
    rows = net.nodes(spark, sf_dir).select("node", (F.lit(-122.3) + node * 37 % 1000 / 5000).alias("lon"), (F.lit(47.6) + node * 91 % 1000 / 5000).alias("lat"))
    x, y = geometry.transverse_mercator(F.col("lon"), F.col("lat"))
    back = rows.select("node", x.alias("x"), y.alias("y")).select("node", *[c.alias(n) for c, n in zip(geometry.geographic(F.col("x"), F.col("y")), ("lon", "lat"), strict=True)])
    return back.select("node", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


def on_earth(line: Column) -> Column:
    """Grid centimetres as longitude and latitude."""

    def place(p: Column) -> Column:
        lon, lat = geometry.geographic(ORIGIN[0] + p["x"] / 100, ORIGIN[1] + p["y"] / 100)
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.transform(line, place)


def layers(spark: SparkSession, sf_dir: str) -> Iterator[tuple[str, DataFrame, str]]:
    """Name, rows with a line column, and GeoJSON type of each layer."""
    lines = cut(edge_lines(spark, sf_dir))
    facts = net.edges(spark, sf_dir).select("edge_id", "name", "cls")
    yield "streets", facts.join(lines.select("edge_id", "line"), "edge_id"), "LineString"
    rings = build.polygons(spark, sf_dir).select("hood", geometry.repaired(F.col("ring")).alias("line"))
    yield "hoods", rings, "Polygon"
    scored = terrain._scored(spark, sf_dir)
    material = cut(corridor_ops.material(scored, net.edges(spark, sf_dir)).select("edge_id", "u", "v"))
    found = corridor_ops.network_components(material.select(F.col("u").alias("a"), F.col("v").alias("b")))
    placed = material.join(found.select(F.col("node").alias("u"), F.col("component").alias("corridor")), "u").join(lines.select("edge_id", "line"), "edge_id")
    merged = merge_lines(placed.select("corridor", "u", "v", "line"), "corridor")
    yield "corridors", merged.select("corridor", F.explode("lines").alias("line")), "LineString"
    barriers = terrain.barriers(spark, sf_dir).orderBy(F.desc("score"), "edge_id").limit(400)
    yield "barriers", barriers.join(lines.select("edge_id", "line"), "edge_id"), "LineString"
    passes = terrain.critical_passes(spark, sf_dir)
    yield "passes", passes.join(lines.select("edge_id", "line"), "edge_id"), "LineString"
    corner = lambda a, b: F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    boxes = extras.basin_layer(spark, sf_dir)
    yield "basins", boxes.select("basin", "corners", "lowest", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")).alias("line")), "Polygon"
    points = streets.access_points(spark, sf_dir).join(net.nodes(spark, sf_dir).select("node", "x", "y"), "node")
    yield "points", points.select("hood", "node", F.array(corner("x", "y")).alias("line")), "Point"


def write(spark: SparkSession, sf_dir: str, folder: str) -> list[str]:
    """Every layer as newline-delimited GeoJSON in longitude and latitude under the folder; returns their names."""
    done = []
    for name, rows, kind in layers(spark, sf_dir):
        files.write_geojson(rows.withColumn("line", on_earth(F.col("line"))), f"{folder}/{name}", "line", kind)
        done.append(name)
    return done
