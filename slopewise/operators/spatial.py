"""Spatial joins as joins on grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewise.functions import geometry
from slopewise.session import cut


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def label_points(points: DataFrame, boxes: DataFrame, label: str, size: float) -> DataFrame:
    """Left join of points (x, y) with the boxes (x0, y0, x1, y1) they lie in; of several the smallest label."""
    cells = boxes.select(
        F.col(label), "x0", "y0", "x1", "y1",
        F.explode(F.sequence(_cell(F.col("x0"), size), _cell(F.col("x1"), size))).alias("__cx"),
    ).withColumn("__cy", F.explode(F.sequence(_cell(F.col("y0"), size), _cell(F.col("y1"), size))))
    placed = points.withColumn("__cx", _cell(F.col("x"), size)).withColumn("__cy", _cell(F.col("y"), size)).withColumn("__id", F.xxhash64(*points.columns))
    within = (placed["x"] >= cells["x0"]) & (placed["x"] <= cells["x1"]) & (placed["y"] >= cells["y0"]) & (placed["y"] <= cells["y1"])
    joined = placed.join(cells, (placed["__cx"] == cells["__cx"]) & (placed["__cy"] == cells["__cy"]) & within, "left")
    return joined.groupBy(*[placed[c] for c in points.columns]).agg(F.min(label).alias(label))


def near(points: DataFrame, targets: DataFrame, key: str, target: str, radius: float) -> DataFrame:
    """(key, target, d2) for all targets within the radius of each point; cells of the radius' size, nine around a point."""
    around = points.select(key, F.col("x").alias("px"), F.col("y").alias("py"))
    around = around.withColumn("cx", F.explode(F.sequence(_cell(F.col("px"), radius) - 1, _cell(F.col("px"), radius) + 1)))
    around = around.withColumn("cy", F.explode(F.sequence(_cell(F.col("py"), radius) - 1, _cell(F.col("py"), radius) + 1)))
    placed = targets.select(target, F.col("x").alias("tx"), F.col("y").alias("ty"), _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    d2 = (F.col("px") - F.col("tx")) ** 2 + (F.col("py") - F.col("ty")) ** 2
    return around.join(placed, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= float(radius) ** 2).select(key, target, "d2")


def nearest(points: DataFrame, targets: DataFrame, key: str, target: str, radius: float) -> DataFrame:
    """(key, target, d2): the nearest target within the radius, of equally near ones the smallest; points without one are left out."""
    return near(points, targets, key, target, radius).groupBy(key).agg(F.min(F.struct("d2", target)).alias("n")).select(key, f"n.{target}", "n.d2")


def snap(points: DataFrame, corners: DataFrame, nodes: DataFrame, key: str, target: str, radius: float) -> DataFrame:
    """(key, target, kind): the nearest corner within the radius, else the nearest node at all; every point gets one if there is a node.

    The search for a node widens its radius four times a round until every
    point has one, so a join never spans more than nine cells of a size that
    fits the remaining points; the number of rounds follows from how far the
    points lie from the nodes.
    """
    best = nearest(points, corners, key, target, radius).withColumn("kind", F.lit("corner"))
    out = best.select(key, target, "kind")
    rest = cut(points.join(best.select(key), key, "left_anti"))
    if nodes.isEmpty():
        return out
    while not rest.isEmpty():
        found = cut(nearest(rest, nodes, key, target, radius))
        out = out.unionByName(found.select(key, target, F.lit("node").alias("kind")))
        rest = cut(rest.join(found.select(key), key, "left_anti"))
        radius *= 4
    return out


def label_polygons(points: DataFrame, polygons: DataFrame, key: str, label: str, size: float) -> DataFrame:
    """(key, label): left join of points (x, y) with the polygons (label, ring) they lie in; of several the smallest label.

    A ring is an array of (x, y) whose last point is its first. A polygon is
    posted in the cells of its box, and a point looks in its own.
    """
    ends = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    over = lambda c: F.explode(F.sequence(_cell(ends(F.array_min, c), size), _cell(ends(F.array_max, c), size)))
    posted = polygons.select(F.col(label).alias("label"), "ring").withColumn("cx", over("x")).withColumn("cy", over("y"))
    placed = points.select(F.col(key).alias("key"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).withColumn("cx", _cell(F.col("px"), size)).withColumn("cy", _cell(F.col("py"), size))
    found = placed.join(posted, ["cx", "cy"]).where(geometry.inside(F.col("ring"), F.col("px"), F.col("py"))).groupBy("key").agg(F.min("label").alias("label"))
    return placed.select("key").join(found, "key", "left").select(F.col("key").alias(key), F.col("label").alias(label))


def within_reach(points: DataFrame, polygons: DataFrame, key: str, reach: float) -> DataFrame:
    """(key, inside): whether a point (x, y) lies in a polygon (ring) or within the reach of one's edge, as in a buffered union of them."""
    size = reach * 8
    ends = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    over = lambda c: F.explode(F.sequence(_cell(ends(F.array_min, c) - reach, size), _cell(ends(F.array_max, c) + reach, size)))
    posted = polygons.select("ring").withColumn("cx", over("x")).withColumn("cy", over("y"))
    placed = points.select(F.col(key).alias("key"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).withColumn("cx", _cell(F.col("px"), size)).withColumn("cy", _cell(F.col("py"), size))
    x, y = F.col("px"), F.col("py")
    gaps = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda p, q: geometry.gap(x, y, p["x"], p["y"], q["x"], q["y"]))
    near = geometry.inside(F.col("ring"), x, y) | (F.array_min(gaps) <= reach)
    found = placed.join(posted, ["cx", "cy"]).where(near).select("key").distinct().withColumn("inside", F.lit(True))
    return placed.select("key").join(found, "key", "left").select(F.col("key").alias(key), F.coalesce("inside", F.lit(False)).alias("inside"))


def polygon_names(lines: DataFrame, boxes: DataFrame, key: str, label: str, size: float) -> DataFrame:
    """(key, names): sorted distinct labels of the boxes that a line's bounding pieces (x0, y0, x1, y1) meet, joined by '; '."""
    spread = lambda df, p: df.withColumn(f"{p}cx", F.explode(F.sequence(_cell(F.col(f"{p}x0"), size), _cell(F.col(f"{p}x1"), size)))).withColumn(f"{p}cy", F.explode(F.sequence(_cell(F.col(f"{p}y0"), size), _cell(F.col(f"{p}y1"), size))))
    a = spread(lines.select(key, *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")]), "a")
    b = spread(boxes.select(label, *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")]), "b")
    meet = (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
    hit = a.join(b, (F.col("acx") == F.col("bcx")) & (F.col("acy") == F.col("bcy")) & meet)
    return hit.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(label).cast("string"))), "; ").alias("names"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of distinct points sorted by x and y."""
    if len(points) < 3:
        return points

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def farthest_ends(ends: DataFrame, key: str) -> DataFrame:
    """(key, d2): squared distance of the two points of a group that are farthest apart.

    The farthest two are corners of the group's hull. Each batch of rows is
    first reduced to the hulls of its groups, so a group's rows never meet as a
    whole; the hulls of hulls are few points.
    """
    schema = ends.select(key, F.col("x").cast("double"), F.col("y").cast("double")).schema

    def hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for value, g in b.groupby(key, dropna=False):
                corners = _hull(np.unique(g[["x", "y"]].to_numpy(), axis=0))
                yield pd.DataFrame({key: value, "x": corners[:, 0], "y": corners[:, 1]})

    def widest(g: pd.DataFrame) -> pd.DataFrame:
        corners = _hull(np.unique(g[["x", "y"]].to_numpy(), axis=0))
        d2 = max((float(((corners - c) ** 2).sum(1).max()) for c in corners), default=0.0)
        return pd.DataFrame({key: [g[key].iloc[0]], "d2": [d2]})

    reduced = ends.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(hulls, schema)
    return reduced.groupBy(key).applyInPandas(widest, f"{schema[key].name} {schema[key].dataType.simpleString()}, d2 double")
