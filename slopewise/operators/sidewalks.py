"""Unnamed footways that only follow a street, and what must stay of them so that nothing is cut off."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewise.operators import paths, spatial
from slopewise.operators.components import network_components
from slopewise.operators.topology import spanning_forest
from slopewise.session import cut

OFFSET, ANGLE, SAMPLES, HITS = 12.0, 30.0, 5, 4
RATIO, SLACK, SNAP = 1.25, 25.0, 30.0


def probe_hits(candidates: DataFrame, streets: DataFrame, offset: float = OFFSET, angle: float = ANGLE) -> DataFrame:
    """(edge_id, near, parallel): of five points of each straight candidate, how many have a street within the offset, and one that runs alike.

    Both tables are (edge_id, x0, y0, x1, y1). Streets are posted in the cells
    that they reach, points look in their own; the nearest street decides, of
    equally near ones that which runs most alike.
    """
    size = offset * 10
    cell = lambda c: F.floor(c / size).cast("long")
    low, high = (lambda a, b: F.least(a, b) - offset), (lambda a, b: F.greatest(a, b) + offset)
    posted = streets.select(*[F.col(c).alias(f"s{c}") for c in ("edge_id", "x0", "y0", "x1", "y1")])
    posted = posted.withColumn("cx", F.explode(F.sequence(cell(low(F.col("sx0"), F.col("sx1"))), cell(high(F.col("sx0"), F.col("sx1"))))))
    posted = posted.withColumn("cy", F.explode(F.sequence(cell(low(F.col("sy0"), F.col("sy1"))), cell(high(F.col("sy0"), F.col("sy1"))))))
    rows = candidates.select("edge_id", F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("heading"), "x0", "y0", "x1", "y1", F.explode(F.array(*[F.lit((2 * k + 1) / (2 * SAMPLES)) for k in range(SAMPLES)])).alias("f"))
    points = rows.select("edge_id", "f", "heading", (F.col("x0") + F.col("f") * (F.col("x1") - F.col("x0"))).alias("px"), (F.col("y0") + F.col("f") * (F.col("y1") - F.col("y0"))).alias("py"))
    points = points.withColumn("cx", cell(F.col("px"))).withColumn("cy", cell(F.col("py")))
    dx, dy = F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("sx0")) * dx + (F.col("py") - F.col("sy0")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))))
    gap = F.hypot(F.col("px") - F.col("sx0") - t * dx, F.col("py") - F.col("sy0") - t * dy)
    met = points.join(posted, ["cx", "cy"]).where("edge_id <> sedge_id").withColumn("gap", gap).where(F.col("gap") <= offset)
    alike = F.abs(F.cos(F.col("heading") - F.atan2(dy, dx)))
    best = met.groupBy("edge_id", "f").agg(F.min(F.struct(F.round("gap", 6).alias("g"), (-alike).alias("a"))).alias("b"))
    hits = best.groupBy("edge_id").agg(F.count(F.lit(1)).alias("near"), F.count_if(-F.col("b.a") >= math.cos(math.radians(angle))).alias("parallel"))
    return candidates.select("edge_id").join(hits, "edge_id", "left").select("edge_id", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("parallel", F.lit(0)).alias("parallel"))


def prune_stubs(edges: DataFrame, stubs: DataFrame) -> DataFrame:
    """Edges without the stubs that end dead, taken away until none does; edges has edge_id, u, v, stubs has edge_id."""
    rows = cut(edges.join(stubs.select("edge_id").withColumn("stub", F.lit(True)), "edge_id", "left").withColumn("stub", F.coalesce("stub", F.lit(False))))
    while True:
        ends = rows.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").count().where("count <= 1").select("n")
        dead = rows.where("stub").select("edge_id", F.explode(F.array("u", "v")).alias("n")).join(ends, "n", "left_semi").select("edge_id").distinct()
        if dead.isEmpty():
            return rows.drop("stub")
        rows = cut(rows.join(dead, "edge_id", "left_anti"))


def reconnect(kept: DataFrame, sidewalks: DataFrame) -> DataFrame:
    """(edge_id, len) of the sidewalks that join the components of what is kept, over the least length; both have edge_id, u, v, len.

    Components become single nodes, a forest of least length over the
    sidewalks joins them, and its branches that end in no component go.
    """
    comp = cut(network_components(kept.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    label = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    rows = sidewalks.select("edge_id", "u", "v", "len").join(label("u"), "u", "left").join(label("v"), "v", "left")
    # Nodes of no component get numbers below zero.
    rows = rows.select("edge_id", F.coalesce("cu", -F.col("u") - 1).alias("u"), F.coalesce("cv", -F.col("v") - 1).alias("v"), F.col("len").cast("double").alias("crest")).where("u <> v")
    forest = cut(spanning_forest(rows))
    while True:
        leaves = forest.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").count().where("count = 1 and n < 0").select("n")
        dead = forest.select("edge_id", F.explode(F.array("u", "v")).alias("n")).join(leaves, "n", "left_semi").select("edge_id").distinct()
        if dead.isEmpty():
            return forest.select("edge_id", F.col("crest").alias("len"))
        forest = cut(forest.join(dead, "edge_id", "left_anti"))


def shortcuts(kept: DataFrame, sidewalks: DataFrame, corners: DataFrame, ratio: float = RATIO, slack: float = SLACK, snap: float = SNAP) -> DataFrame:
    """(edge_id) of the sidewalks that what is kept cannot stand in for.

    kept is (u, v, len), sidewalks (edge_id, u, v, len, x0, y0, x1, y1), corners
    (node, x, y) the nodes of streets. An end that is not part of the kept
    network moves to the nearest corner of it within reach. A sidewalk is a
    shortcut if an end has none, or if the way between its ends is longer than
    the ratio of its length and both moves, and the slack.
    """
    alive = cut(kept.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    ends = sidewalks.select("edge_id", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("node"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("side"), F.col("v").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y")))))
    ends = cut(ends.withColumn("end", F.col("edge_id") * 2 + F.col("side")))
    own = ends.join(alive, "node", "left_semi").select("end", F.col("node").alias("at"), F.lit(0.0).alias("move"))
    moved = spatial.nearest(ends.join(alive, "node", "left_anti"), corners.join(alive, "node", "left_semi"), "end", "node", snap)
    found = own.unionByName(moved.select("end", F.col("node").alias("at"), F.sqrt("d2").alias("move")))
    at = lambda side: found.where(F.col("end") % 2 == side).select(F.expr("end div 2").alias("edge_id"), F.col("at").alias(f"at{side}"), F.col("move").alias(f"move{side}"))
    both = cut(sidewalks.select("edge_id", "len").join(at(0), "edge_id").join(at(1), "edge_id"))
    asked = both.select(F.col("edge_id").alias("request"), F.col("at0").alias("source"), F.col("at1").alias("target"), (ratio * (F.col("len") + F.col("move0") + F.col("move1")) + slack).alias("budget"))
    ways = kept.select("u", "v", "len").unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v"), "len")).groupBy("u", "v").agg(F.min("len").cast("double").alias("cost"))
    arcs = ways.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0).cast("long").alias("arc_id"), "cost")
    return sidewalks.select("edge_id").join(paths.within(arcs, asked).withColumnRenamed("request", "edge_id"), "edge_id", "left_anti")


def drop_sidewalks(edges: DataFrame, candidates: DataFrame, streets: DataFrame) -> DataFrame:
    """Edges without the candidates that follow a street, but with those that are shortcuts or hold the rest together, and without dead ends left of them.

    edges is (edge_id, u, v, len); candidates and streets have x0, y0, x1, y1
    besides, and are among the edges. Only footways beside a street that do not
    run along it are taken away as dead ends; what was put back stays.
    """
    hits = cut(probe_hits(candidates, streets))
    follow = hits.where(F.col("parallel") >= HITS).select("edge_id")
    stub = hits.where((F.col("near") >= HITS) & (F.col("parallel") < HITS)).select("edge_id")
    solid = streets.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("v").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y"))))).dropDuplicates(["node"])
    rest = edges.join(follow, "edge_id", "left_anti")
    short = shortcuts(rest, candidates.join(follow, "edge_id", "left_semi").select("edge_id", "u", "v", "len", "x0", "y0", "x1", "y1"), solid)
    sidewalk = cut(follow.join(short, "edge_id", "left_anti"))
    rest = cut(edges.join(sidewalk, "edge_id", "left_anti"))
    back = reconnect(rest, edges.join(sidewalk, "edge_id", "left_semi"))
    return prune_stubs(rest.unionByName(edges.join(back.select("edge_id"), "edge_id", "left_semi")), stub)
