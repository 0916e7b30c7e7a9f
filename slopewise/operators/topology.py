"""Strong components, bottleneck trees, basins and passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopewise.operators.components import network_components
from slopewise.operators.paths import Network, fits
from slopewise.session import cut


def strong_components(net: Network) -> np.ndarray:
    """Component number of every node, by Tarjan's algorithm without recursion."""
    first, head = net.first.tolist(), net.head.tolist()
    n = len(net.ids)
    index, low, comp, stack, on = [-1] * n, [0] * n, [-1] * n, [], [False] * n
    count = found = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, first[root])]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            v, e = work.pop()
            if e < first[v + 1]:
                work.append((v, e + 1))
                w = head[e]
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, first[w]))
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    on[w] = False
                    comp[w] = found
                    if w == v:
                        break
                found += 1
    return np.array(comp)


def _reach(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that can be reached from those of start, by frontier joins."""
    known = front = cut(start.select("node").distinct())
    while True:
        step = front.join(arcs.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(known, "node", "left_anti"))
        if front.isEmpty():
            return known
        known = cut(known.unionByName(front))


def largest_strong_component(arcs: DataFrame) -> DataFrame:
    """(node) of the largest strongly connected component, of equally large ones that with the smallest node.

    Where the network is too large for one worker, components are peeled off by
    forward and backward reach until one holds at least half of what is left.
    """
    spark = arcs.sparkSession
    if fits(arcs):
        net = Network.of(arcs.withColumn("cost", F.lit(1.0)), "cost")
        if not len(net.ids):
            return spark.createDataFrame([], "node long")
        comp = strong_components(net)
        sizes = np.bincount(comp)
        best = min(np.flatnonzero(sizes == sizes.max()), key=lambda c: net.ids[comp == c].min())
        return spark.createDataFrame(pd.DataFrame({"node": net.ids[comp == best]}), "node long")
    left = cut(arcs.select("src", "dst").distinct())
    best, size = None, 0
    while True:
        ends = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        total = ends.count()
        if total <= size:
            return best
        pivot = left.groupBy(F.col("src").alias("node")).count().orderBy(F.desc("count"), "node").limit(1)
        there = _reach(left, pivot)
        back = _reach(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pivot)
        mine = cut(there.join(back, "node", "left_semi"))
        n = mine.count()
        if n > size:
            best, size = mine, n
        keep = left.join(mine.withColumnRenamed("node", "src"), "src", "left_anti").join(mine.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = cut(keep)
        if left.isEmpty():
            return best


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v, crest, edge_id) of the forest that joins everything over the lowest crests, of equal ones the smallest edge_id.

    Where the network is small, every task reduces its edges to a forest of its
    own before they meet in one; a larger one is joined round by round.
    """
    rows = edges.select("u", "v", F.col("crest").cast("double").alias("crest"), "edge_id")
    return edges.sparkSession.createDataFrame(_forest(rows), "u long, v long, crest double, edge_id long") if fits(rows) else forest_by_joins(rows)


def _forest(rows: DataFrame) -> pd.DataFrame:
    """The forest on the driver. Raises ValueError if the network is too large for that."""
    if not fits(rows):
        raise ValueError("the network is too large for one worker")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = _kruskal(b if held is None else pd.concat([held, b]))
        if held is not None:
            yield held

    return _kruskal(rows.mapInPandas(reduce, rows.schema).toArrow().to_pandas())


def forest_by_joins(edges: DataFrame) -> DataFrame:
    """The same by rounds in which each part takes its lowest edge to another part; their number at least halves each time."""
    rows = edges.select("u", "v", "crest", "edge_id").where("u <> v")
    home = cut(rows.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("part", F.col("node")))
    taken = None
    left = cut(rows.select("*", F.col("u").alias("a"), F.col("v").alias("b")))
    while not left.isEmpty():
        ways = left.select("a", "b", "crest", "edge_id", "u", "v").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "crest", "edge_id", "u", "v"))
        lowest = cut(ways.groupBy("a").agg(F.min(F.struct("crest", "edge_id", "b", "u", "v")).alias("e")).select("a", "e.*").dropDuplicates(["edge_id"]))
        more = lowest.select("u", "v", "crest", "edge_id")
        taken = more if taken is None else taken.unionByName(more)
        joined = network_components(lowest, "a", "b").withColumnRenamed("node", "part")
        home = cut(home.join(joined, "part", "left").select("node", F.coalesce("component", "part").alias("part")))
        now = lambda end, to: home.select(F.col("node").alias(end), F.col("part").alias(to))
        left = cut(left.drop("a", "b").join(now("u", "a"), "u").join(now("v", "b"), "v").where("a <> b"))
    return rows.limit(0) if taken is None else taken


def _kruskal(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["crest", "edge_id"])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for u, v in zip(rows["u"], rows["v"], strict=True):
        a, b = find(u), find(v)
        keep.append(a != b)
        parent[a] = b
    return rows[np.array(keep, bool)]


class MergeTree:
    """Nodes as leaves; every edge of the forest, from the lowest crest on, joins two trees under a new root."""

    def __init__(self, forest: pd.DataFrame):
        self.leaf: dict[int, int] = {}
        self.up: list[int] = []
        self.label: list[tuple[float, int]] = []
        root: list[int] = []

        def new(label: tuple[float, int]) -> int:
            self.up.append(-1)
            root.append(len(root))
            self.label.append(label)
            return len(root) - 1

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for u, v, crest, edge in zip(forest["u"], forest["v"], forest["crest"], forest["edge_id"], strict=True):
            ends = []
            for node in (u, v):
                if node not in self.leaf:
                    self.leaf[node] = new((-np.inf, -1))
                ends.append(find(self.leaf[node]))
            top = new((crest, edge))
            for e in ends:
                self.up[e] = root[e] = top
        # A root comes after what hangs under it, so that its jump is known first; jumps make a walk upwards as long as the logarithm of the depth.
        n = len(self.up)
        self.depth, self.jump = [0] * n, list(range(n))
        for x in range(n - 1, -1, -1):
            p = self.up[x]
            if p >= 0:
                j = self.jump[p]
                self.depth[x] = self.depth[p] + 1
                self.jump[x] = self.jump[j] if self.depth[p] - self.depth[j] == self.depth[j] - self.depth[self.jump[j]] else p

    def height(self, a: int, b: int) -> tuple[float, int] | None:
        """Lowest crest over which one gets from a to b, and its edge; None if either is unknown or they do not join."""
        if a not in self.leaf or b not in self.leaf:
            return None
        x, y = self.leaf[a], self.leaf[b]
        if self.depth[x] < self.depth[y]:
            x, y = y, x
        while self.depth[x] > self.depth[y]:
            x = self.jump[x] if self.depth[self.jump[x]] >= self.depth[y] else self.up[x]
        while x != y:
            if self.depth[x] == 0:
                return None
            x, y = (self.jump[x], self.jump[y]) if self.jump[x] != self.jump[y] else (self.up[x], self.up[y])
        return self.label[x]


def pass_heights(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, height, edge_id) for each pair of nodes that join; the tree is sent to the workers once, so its network has a bound."""
    tree = MergeTree(_forest(edges.select("u", "v", F.col("crest").cast("double").alias("crest"), "edge_id")))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(a, b, *h) for a, b in zip(rows["a"], rows["b"], strict=True) if (h := tree.height(a, b)) is not None]
            yield pd.DataFrame(found, columns=["a", "b", "height", "edge_id"])

    return pairs.select("a", "b").mapInPandas(look, "a long, b long, height double, edge_id long")


def basins(edges: DataFrame, heights: DataFrame, threshold: float, least: float) -> DataFrame:
    """(node, basin): components of streets both of whose ends are at most so high, if their streets add up to the least length.

    Of parallel streets only the shortest counts. heights is (node, z).
    """
    low = heights.where(F.col("z") <= threshold).select("node")
    inside = edges.join(low.withColumnRenamed("node", "u"), "u", "left_semi").join(low.withColumnRenamed("node", "v"), "v", "left_semi")
    once = inside.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("len").alias("len"))
    found = network_components(once)
    sizes = once.join(found.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.sum("len").alias("total")).where(F.col("total") >= least)
    return found.join(sizes, "component").select("node", F.col("component").alias("basin"))


def basin_passes(edges: DataFrame, basin_of: DataFrame) -> DataFrame:
    """(edge_id, crest, first, second): where, with rising crests, two sets of basins first join.

    Sets of basins are joined in one pass over the forest, whose size is checked.
    """
    forest = _forest(edges.select("u", "v", F.col("crest").cast("double").alias("crest"), "edge_id"))
    label = {r.node: r.basin for r in basin_of.collect()}
    parent: dict[int, int] = {}
    held: dict[int, set[int]] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for u, v, crest, edge in zip(forest["u"], forest["v"], forest["crest"], forest["edge_id"], strict=True):
        a, b = find(u), find(v)
        left = held.pop(a, None) or ({label[u]} if u in label else set())
        right = held.pop(b, None) or ({label[v]} if v in label else set())
        if left and right and not left & right:
            out.append((int(edge), float(crest), ",".join(map(str, sorted(left))), ",".join(map(str, sorted(right)))))
        parent[a] = b
        held[b] = left | right
    return edges.sparkSession.createDataFrame(out, "edge_id long, crest double, first string, second string")


def basin_names(edges: DataFrame, basin_of: DataFrame, hood_of: DataFrame, least: float) -> DataFrame:
    """(basin, label, hoods): the three neighbourhoods with most of its streets, and all with more than the least length."""
    inside = edges.join(basin_of.withColumnRenamed("node", "u"), "u").join(basin_of.select(F.col("node").alias("v"), F.col("basin").alias("other")), "v").where("basin = other")
    parts = inside.join(hood_of, "edge_id").where("hood is not null").groupBy("basin", "hood").agg(F.sum("len").alias("len"))
    ranked = parts.withColumn("r", F.row_number().over(W.partitionBy("basin").orderBy(F.desc("len"), "hood")))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", F.col("hood").cast("string").alias("h"))))), lambda x: x["h"])
    long = F.array_sort(F.collect_list(F.when(F.col("len") > least, F.col("hood").cast("string"))))
    return ranked.groupBy("basin").agg(F.array_join(top, " / ").alias("label"), F.array_join(long, "; ").alias("hoods"))


def critical_passes(matrix: DataFrame) -> DataFrame:
    """(edge_id, pairs, height, ends) of the edges over which the pairs (a, b, height, edge_id) must go."""
    return matrix.groupBy("edge_id").agg(F.count(F.lit(1)).alias("pairs"), F.min("height").alias("height"), F.array_join(F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))), lambda x: x.cast("string")), ",").alias("ends"))


def barriers(steps: DataFrame, arcs: DataFrame, min_grade: float) -> DataFrame:
    """Steep edges by how often routes use them: (edge_id, shortest, flat, unavoidable, score).

    steps is (objective, request, arc_id); flat counts the routes of all other
    objectives, as a mean over them. An edge is unavoidable as far as flat
    routes use it as well.
    """
    steep = arcs.where(F.col("gain") + F.col("loss") >= F.col("len") * min_grade).select("arc_id", "edge_id")
    used = steps.join(steep, "arc_id").select("objective", "request", "edge_id").distinct()
    others = F.greatest(F.lit(1), F.countDistinct("objective") - 1)
    flat_kinds = steps.agg(others.alias("kinds"))
    counts = used.groupBy("edge_id").agg(F.count_if(F.col("objective") == "shortest").alias("shortest"), F.count_if(F.col("objective") != "shortest").alias("n"))
    rows = counts.where("shortest > 0").join(F.broadcast(flat_kinds)).withColumn("flat", F.col("n") / F.col("kinds"))
    rows = rows.withColumn("unavoidable", F.least(F.lit(1.0), F.col("flat") / F.col("shortest")))
    return rows.select("edge_id", "shortest", F.round("flat", 6).alias("flat"), F.round("unavoidable", 6).alias("unavoidable"), F.round(F.col("shortest") * (1 - F.col("unavoidable")), 6).alias("score"))
