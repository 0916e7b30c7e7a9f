"""Shortest paths, as parallel kernels over a broadcast network and as joins beyond that.

A request is one row (request, source[, target]); the network is a table
(src, dst, arc_id, cost). It is written to the shared folder and counted there.
Of at most MOST_BYTES as sorted arrays with one cost, it is read from there by
the workers, never through the driver, and each request is solved there; a
larger one is relaxed by joins, frontier by frontier, with the arcs by which
nodes are reached. The searches over labels (frontiers and round trips) have no
such form: for networks larger than that they raise an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopewise.session import cut, fresh_path, opened

#: Bytes of the arrays of a network that a worker holds.
MOST_BYTES = 1 << 28
#: Costs of nodes that are searched at once, over all sources of a turn.
MOST_CELLS = 1 << 23


class TooLarge(ValueError):
    """A network that is not sent to workers."""


class Network:
    """Arcs grouped by their start, nodes numbered by rank."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, arc: np.ndarray, *costs: np.ndarray):
        self.ids = np.unique(np.concatenate([src, dst]))
        tail, head = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.lexsort((arc, tail))
        self.head, self.arc, self.costs = head[order].astype(np.int32), arc[order], [c[order] for c in costs]
        self.tail = tail[order].astype(np.int32)
        self.first, self.order = np.searchsorted(self.tail, np.arange(len(self.ids) + 1)), order.astype(np.int32)

    @classmethod
    def of(cls, arcs: DataFrame, *costs: str) -> Network:
        """Raises TooLarge for a network that is too large to send; it is read once, no farther than a row beyond the bound."""
        most = MOST_BYTES // (8 * (3 + len(costs)))
        rows = arcs.select(*[F.col(c).cast("long") for c in ("src", "dst", "arc_id")], *[F.col(c).cast("double") for c in costs]).limit(most + 1).toArrow()
        if len(rows) > most:
            raise TooLarge(f"the network's arrays exceed {MOST_BYTES} bytes")
        return cls(*(rows[c].to_numpy() for c in ("src", "dst", "arc_id", *costs)))

    def number(self, node: int) -> int:
        at = int(np.searchsorted(self.ids, node))
        return at if at < len(self.ids) and self.ids[at] == node else -1

    def reverse(self) -> Network:
        return Network(self.ids[self.head], self.ids[self.tail], self.arc, *self.costs)

    def tree(self, source: int, which: int = 0, targets: set[int] | None = None, cutoff: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Cost to every node and the arc by which it is reached (-1); stops when all targets are settled."""
        if not hasattr(self, "_lists"):
            self._lists = self.first.tolist(), self.head.tolist(), [c.tolist() for c in self.costs]
        first, head, costs = self._lists
        cost = costs[which]
        n = len(self.ids)
        best, via, done = [np.inf] * n, [-1] * n, [False] * n
        best[source] = 0.0
        heap, left = [(0.0, source)], set(targets) if targets is not None else None
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            if left is not None:
                left.discard(v)
                if not left:
                    break
            for e in range(first[v], first[v + 1]):
                w, new = head[e], d + cost[e]
                if new < best[w] and new <= cutoff:
                    best[w], via[w] = new, e
                    heapq.heappush(heap, (new, w))
        return np.array(best), np.array(via)

    def settled(self, sources: list[int], targets: list[set[int]] | None = None) -> Iterator[np.ndarray]:
        """Costs to every node under the first cost, a row a source, for as many sources at a time as MOST_CELLS lets; final for the targets and all that is nearer.

        Open nodes that lie before a line are relaxed at once, until none is left there; then the line moves on to a few arcs behind the nearest of the others.
        """
        cost, n = self.costs[0], len(self.ids)
        if len(cost) and cost.min() <= 0:
            yield from (self.tree(s, 0, targets[k] if targets else None)[0][None] for k, s in enumerate(sources))
            return
        step = 1.5 * float(cost.mean()) if len(cost) else 1.0
        turn, fans, count = max(1, MOST_CELLS // max(n, 1)), np.diff(self.first), np.arange(1 << 12)
        for begin in range(0, len(sources), turn):
            own = np.array(sources[begin : begin + turn], np.int64)
            # A cell is a node under a source: 1 if it waits before the line, 2 behind it.
            best, waits, last = np.full(len(own) * n, np.inf), np.zeros(len(own) * n, np.int8), np.empty(len(own) * n, np.int32)
            near, behind, line = np.empty(0, np.int64), [np.arange(len(own)) * n + own], 0.0
            wanted = np.array([k * n + t for k, ends in enumerate(targets[begin : begin + turn]) for t in ends], np.int64) if targets else None
            best[behind[0]], waits[behind[0]] = 0.0, 2
            while True:
                if not len(near):
                    rest = np.concatenate(behind)
                    rest = rest[waits[rest] == 2]  # what fell before the line was relaxed
                    if not len(rest):
                        break
                    far = best[rest]
                    least = far.min()
                    if wanted is not None and best[wanted].max(initial=0.0) <= least:
                        break
                    line = least + step
                    near, behind = rest[far < line], [rest[far >= line]]
                    if not len(near):  # costs so large that a step is nothing to them
                        near, behind = rest, []
                waits[near] = 0
                node = near % n
                fan = fans.take(node)
                ends = np.cumsum(fan)
                if ends[-1] > len(count):
                    count = np.arange(2 * ends[-1])
                arcs = np.repeat(self.first.take(node) - ends + fan, fan) + count[: ends[-1]]
                to, new = np.repeat(near - node, fan) + self.head.take(arcs), np.repeat(best.take(near), fan) + cost.take(arcs)
                falls = np.flatnonzero(new < best.take(to))
                to = to.take(falls)
                np.minimum.at(best, to, new.take(falls))
                state = waits.take(to)
                to = to[(state == 0) | ((state == 2) & (best.take(to) < line))]
                last[to] = count[: len(to)]
                to = to[last.take(to) == count[: len(to)]]  # each once
                now = best.take(to) < line
                near, late = to[now], to[~now]
                waits[near], waits[late] = 1, 2
                behind.append(late)
            yield best.reshape(len(own), n)

    def trees(self, sources: list[int], targets: list[set[int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What tree gives for each source in turn under the first cost, many sources and nodes at a time; of arcs that are equally good the smallest is taken."""
        cost, n = self.costs[0], len(self.ids)
        if len(cost) and cost.min() <= 0:
            yield from (self.tree(s, 0, targets[k] if targets else None) for k, s in enumerate(sources))
            return
        rows = (row for rows in self.settled(sources, targets) for row in rows)
        for source, found in zip(sources, rows, strict=True):
            via = np.full(n, -1, np.int64)
            used = np.flatnonzero((found[self.tail] + cost == found[self.head]) & np.isfinite(found[self.head]))
            used = used[np.argsort(self.arc[used], kind="stable")[::-1]]
            via[self.head[used]] = used  # the last one written stays: the smallest arc
            via[source] = -1
            yield found, via

    def ways(self, sources: list[int], targets: list[set[int]]) -> Iterator[dict[int, tuple[float, np.ndarray]]]:
        """For each source in turn the cost and the positions of the arcs to each target that it reaches, as trees and path give them.

        All ways of a turn are followed back together, so that no tree is made of which few arcs are asked for.
        """
        cost, n = self.costs[0], len(self.ids)
        if len(cost) and cost.min() <= 0:
            for source, ends in zip(sources, targets, strict=True):
                best, via = self.tree(source, 0, ends)
                yield {t: (best[t], np.array(self.path(via, t), np.int64)) for t in ends if np.isfinite(best[t])}
            return
        if not hasattr(self, "_into"):
            order = np.lexsort((self.arc, self.head)).astype(np.int32)
            self._into = np.searchsorted(self.head[order], np.arange(n + 1)), order
        into, order = self._into
        begin = 0
        for rows in self.settled(sources, targets):
            best = rows.reshape(-1)
            asked = [(k, t) for k in range(len(rows)) for t in targets[begin + k] if np.isfinite(rows[k, t])]
            base, at = np.array([k * n for k, _ in asked], np.int64), np.array([t for _, t in asked], np.int64)
            root = np.array([sources[begin + k] for k, _ in asked], np.int64)
            rounds, live = [], np.flatnonzero(at != root)
            while len(live):
                first = into[at[live]]
                fan = into[at[live] + 1] - first
                which = np.repeat(np.arange(len(live)), fan)
                arcs = order[np.repeat(first - np.cumsum(fan) + fan, fan) + np.arange(len(which))]
                good = best[base[live][which] + self.tail[arcs]] + cost[arcs] == best[base[live] + at[live]][which]
                arcs = arcs[good][np.flatnonzero(np.diff(which[good], prepend=-1))]  # the smallest of each
                rounds.append((live, arcs))
                at[live] = self.tail[arcs]
                live = live[at[live] != root[live]]
            owner = np.concatenate([live for live, _ in rounds]) if rounds else np.empty(0, np.int64)
            taken = np.concatenate([arcs for _, arcs in rounds]) if rounds else np.empty(0, np.int64)
            by = np.argsort(owner, kind="stable")
            steps = np.split(taken[by], np.cumsum(np.bincount(owner, minlength=len(asked)))[:-1]) if asked else []
            out: list[dict[int, tuple[float, np.ndarray]]] = [{} for _ in rows]
            for (k, t), way in zip(asked, steps, strict=True):
                out[k][t] = rows[k, t], way[::-1]
            yield from out
            begin += len(rows)

    def path(self, via: np.ndarray, target: int) -> list[int]:
        """Positions of the arcs from the tree's root to a node."""
        out = []
        while via[target] >= 0:
            out.append(int(via[target]))
            target = int(self.tail[via[target]])
        return out[::-1]


def spread(requests: DataFrame, *keys: str) -> DataFrame:
    """Deals requests out by key to as many tasks as run at once; they are few rows with much work behind each, so they must not be coalesced."""
    return requests.repartition(requests.sparkSession.sparkContext.defaultParallelism, *keys)


def fits(arcs: DataFrame, costs: int = 1) -> bool:
    """Whether ends, numbers and so many costs of the arcs stay within MOST_BYTES."""
    most = MOST_BYTES // (8 * (3 + costs))
    return arcs.limit(most + 1).count() <= most


class Stored:
    """A network in the shared folder, which each worker reads once."""

    def __init__(self, arcs: DataFrame, *costs: str):
        """Raises TooLarge if a worker could not hold it with one cost."""
        spark = arcs.sparkSession
        self.path = fresh_path(spark, "network")
        arcs.select(*[F.col(c).cast("long") for c in ("src", "dst", "arc_id")], *[F.col(c).cast("double") for c in costs]).write.parquet(self.path)
        many = spark.read.parquet(self.path).count()
        if many * 8 * 4 > MOST_BYTES:
            raise TooLarge(f"the network's arrays exceed {MOST_BYTES} bytes")

    def load(self, cost: str) -> Network:
        """The network with that cost, on a worker, which keeps the last one."""
        if _HELD.get("path") != self.path:
            _HELD.clear()
            store, at = opened(self.path)
            read = lambda c: pq.read_table(at, columns=[c], filesystem=store, use_threads=False)[c].to_numpy()
            net = Network(*(read(c) for c in ("src", "dst", "arc_id")))
            _HELD.update(path=self.path, net=net, read=read)
        net = _HELD["net"]
        if _HELD.get("cost") != cost:
            net.costs, _HELD["cost"] = [_HELD["read"](cost)[net.order]], cost
            net.__dict__.pop("_lists", None)
        return net


#: What a worker has read last.
_HELD: dict = {}


def distances(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, cost) of all nodes that a source reaches, itself at 0 included."""
    try:
        stored = Stored(arcs, "cost")
    except TooLarge:
        return distances_by_joins(arcs, sources)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            net = stored.load("cost")
            at = {s: net.number(s) for s in b["source"]}
            known = [s for s in at if at[s] >= 0]
            rows = (row for rows in net.settled([at[s] for s in known]) for row in rows)
            for source, cost in zip(known, rows, strict=True):
                found = np.isfinite(cost)
                yield pd.DataFrame({"source": source, "node": net.ids[found], "cost": cost[found]})

    return spread(sources.select("source").distinct()).mapInPandas(solve, "source long, node long, cost double").hint("merge")


def distances_by_joins(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """The same by relaxing a frontier with joins, for networks too large to send to workers."""
    start = sources.select("source").distinct().select(F.lit("cost").alias("objective"), "source")
    return _trees(arcs.select("src", "dst", "arc_id", F.lit("cost").alias("objective"), "cost"), start).select("source", "node", "cost")


def _trees(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """(objective, source, node, cost, via) of all nodes that a source reaches; via is the arc by which, null at the source.

    arcs is (src, dst, arc_id, objective, cost). Rounds end when no cost falls
    any more; as costs are positive, a round for each arc of the longest way is
    the most there can be. Of arcs that are equally good the smallest is taken.
    """
    key = ["objective", "source", "node"]
    known = cut(start.select("objective", "source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("via")))
    front = known
    steps = arcs.select("objective", F.col("src").alias("node"), "dst", "arc_id", F.col("cost").cast("double").alias("c"))
    while not front.isEmpty():
        moved = front.join(steps, ["objective", "node"]).groupBy("objective", "source", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("c")).alias("cost"), F.col("arc_id").alias("via"))).alias("new"))
        fresh = F.col("cost").isNull() | (F.col("new.cost") < F.col("cost"))
        merged = cut(known.join(moved, key, "full").select(*key, F.when(fresh, F.col("new.cost")).otherwise(F.col("cost")).alias("cost"), F.when(fresh, F.col("new.via")).otherwise(F.col("via")).alias("via"), F.coalesce(fresh & F.col("new").isNotNull(), F.lit(False)).alias("moved")))
        known, front = merged.drop("moved"), merged.where("moved").drop("moved")
    return known


def within(arcs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request) of the requests (request, source, target, budget) whose target can be reached for at most the budget."""
    try:
        stored = Stored(arcs, "cost")
    except TooLarge:
        return _within_by_joins(arcs, requests)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, net = [], stored.load("cost")
            for source, rows in b.groupby("source"):
                at = net.number(source)
                if at >= 0:
                    cost, _ = net.tree(at, cutoff=float(rows["budget"].max()))
                    ends = [net.number(t) for t in rows["target"]]
                    found += [r for r, e, most in zip(rows["request"], ends, rows["budget"], strict=True) if e >= 0 and cost[e] <= most]
            yield pd.DataFrame({"request": found})

    return spread(requests, "source").mapInPandas(solve, "request long")


def _within_by_joins(arcs: DataFrame, requests: DataFrame) -> DataFrame:
    """The same, the frontier of each source going no farther than the largest budget there."""
    front = cut(requests.groupBy("source").agg(F.max("budget").alias("most")).select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), "most"))
    known, steps = front, arcs.select(F.col("src").alias("node"), "dst", F.col("cost").cast("double").alias("c"))
    while not front.isEmpty():
        moved = front.join(steps, "node").where(F.col("cost") + F.col("c") <= F.col("most")).groupBy("source", F.col("dst").alias("node"), "most").agg(F.min(F.col("cost") + F.col("c")).alias("new"))
        fresh = F.col("cost").isNull() | (F.col("new") < F.col("cost"))
        merged = cut(known.join(moved, ["source", "node", "most"], "full").select("source", "node", F.least("cost", "new").alias("cost"), "most", (F.col("new").isNotNull() & fresh).alias("moved")))
        known, front = merged.drop("moved"), merged.where("moved").drop("moved")
    return requests.join(known.select("source", F.col("node").alias("target"), "cost"), ["source", "target"]).where("cost <= budget").select("request")


def routes_by_joins(arcs: DataFrame, requests: DataFrame, costs: tuple[str, ...] = ("cost",)) -> DataFrame:
    """What routes gives, by joins alone: trees first, then all routes at once back from their targets, an arc a round."""
    long = arcs.select("src", "dst", "arc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("objective"), F.col(c).cast("double").alias("cost")) for c in costs])).alias("k")).select("src", "dst", "arc_id", "k.*")
    asked = requests.select("request", "source", "target", F.explode(F.array(*[F.lit(c) for c in costs])).alias("objective"))
    ends = arcs.select(F.explode(F.array("src", "dst")).alias("source")).distinct()
    trees = _trees(long, asked.select("objective", "source").distinct().join(ends, "source", "left_semi"))
    key = ["objective", "source", "node"]
    reached = cut(asked.join(trees.withColumnRenamed("node", "target"), ["objective", "source", "target"]))
    tails = arcs.select(F.col("arc_id").alias("via"), "src")
    at = reached.select("objective", "request", "source", F.col("target").alias("node"))
    taken, number = None, 0
    while True:
        step = cut(at.join(trees.select(*key, "via"), key).where("via is not null").join(tails, "via"))
        if step.isEmpty():
            break
        arc = step.select("objective", "request", F.struct(F.lit(-number).alias("at"), F.col("via").alias("arc")).alias("x"))
        taken = arc if taken is None else taken.unionByName(arc)
        at, number = step.select("objective", "request", "source", F.col("src").alias("node")), number + 1
    none = F.array().cast("array<long>")
    if taken is None:
        return reached.select("objective", "request", "source", "target", "cost", none.alias("arcs"))
    paths = taken.groupBy("objective", "request").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["arc"]).alias("arcs"))
    return reached.join(paths, ["objective", "request"], "left").select("objective", "request", "source", "target", "cost", F.coalesce("arcs", none).alias("arcs"))


def routes(arcs: DataFrame, requests: DataFrame, costs: tuple[str, ...] = ("cost",)) -> DataFrame:
    """(objective, request, source, target, cost, arcs) for each request and cost column whose target can be reached.

    requests is (request, source, target). One tree serves all requests of a
    source and cost. A route from a node to itself has no arcs. Arcs may be
    parallel; the cheapest serves. A network too large for a worker is solved by
    joins.
    """
    try:
        stored = Stored(arcs, *costs)
    except TooLarge:
        return routes_by_joins(arcs, requests, costs)
    schema = "objective string, request long, source long, target long, cost double, arcs array<long>"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for objective, rows in b.groupby("objective"):
                net, asked = stored.load(objective), []
                for source, ends in zip(rows["source"], rows["ends"], strict=True):
                    at = net.number(source)
                    known = [(r["request"], r["target"], t) for r in ends if (t := net.number(r["target"])) >= 0]
                    if at >= 0 and known:
                        asked.append((source, at, known))
                found = net.ways([at for _, at, _ in asked], [{t for _, _, t in known} for _, _, known in asked])
                for (source, _, known), ways in zip(asked, found, strict=True):
                    out = [(objective, request, source, target, ways[t][0], net.arc[ways[t][1]]) for request, target, t in known if t in ways]
                    if out:
                        yield pd.DataFrame(out, columns=["objective", "request", "source", "target", "cost", "arcs"])

    asked = requests.withColumn("objective", F.explode(F.array(*[F.lit(c) for c in costs])))
    # A row a tree, so that no batch cuts the requests of one apart. Routes are searched once, however often a query reads them,
    # and joined by merging, as Spark takes them to be as small as the requests.
    asked = asked.groupBy("objective", "source").agg(F.collect_list(F.struct("request", "target")).alias("ends"))
    return cut(spread(asked).mapInPandas(solve, schema)).hint("merge")


def steps(routes: DataFrame) -> DataFrame:
    """(objective, request, pos, arc_id), one row an arc."""
    return routes.select("objective", "request", F.posexplode("arcs").alias("pos", "arc_id"))


def summary(steps: DataFrame, arcs: DataFrame) -> DataFrame:
    """Sums and grades of each route; arcs has arc_id, len, gain, loss, z_from, z_to."""
    rows = steps.join(arcs, "arc_id").withColumn("grade", F.col("gain") / F.col("len"))
    return rows.groupBy("request").agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("distance"), F.sum("gain").alias("gain"), F.sum("loss").alias("loss"),
        (F.max_by("z_to", "pos") - F.min_by("z_from", "pos")).alias("net"), F.round(F.max("grade"), 8).alias("max_grade"),
        F.round(F.sum(F.col("gain") + F.col("loss")) / F.sum("len"), 8).alias("avg_abs_grade"), F.round(F.percentile("grade", F.lit(0.95)), 8).alias("p95_grade"),
    )


def comparisons(rows: DataFrame) -> DataFrame:
    """Adds what each route costs and saves against the shortest of the same trip.

    rows has mode, objective, origin, destination, distance, gain. The share
    saved is 0 where the shortest does not climb; efficiency is null unless the
    detour is longer than a metre; all are null without a shortest route.
    """
    trip = W.partitionBy("mode", "origin", "destination")
    base = lambda c: F.max(F.when(F.col("objective") == "shortest", F.col(c))).over(trip)
    rows = rows.withColumn("base_distance", base("distance")).withColumn("base_gain", base("gain"))
    rows = rows.withColumn("detour", F.col("distance") - F.col("base_distance")).withColumn("saved", F.col("base_gain") - F.col("gain"))
    return rows.withColumn("detour_ratio", F.round(F.col("distance") / F.col("base_distance"), 8)).withColumn(
        "saved_pct", F.when(F.col("base_gain") > 0, F.round(100 * F.col("saved") / F.col("base_gain"), 6)).when(F.col("base_gain").isNotNull(), 0.0)
    ).withColumn("efficiency", F.when(F.col("detour") > 100, F.round(F.col("saved") / F.col("detour"), 8)))


def non_dominated(rows: DataFrame, key: list[str], minimise: list[str]) -> DataFrame:
    """Rows of which no other row of the key is at least as good throughout and better somewhere; equal rows both stay."""
    points = rows.select(*key, *minimise).distinct()
    other = points.select(*[F.col(k).alias(f"__{k}") for k in key], *[F.col(c).alias(f"__{c}") for c in minimise])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    better = F.lit(False)
    for c in minimise:
        same, better = same & (F.col(f"__{c}") <= F.col(c)), better | (F.col(f"__{c}") < F.col(c))
    return rows.join(other, same & better, "left_anti")


def frontier(arcs: DataFrame, requests: DataFrame, first: str, second: str) -> DataFrame:
    """(request, first, second, arcs): all trade-offs between two costs, in rising first and falling second.

    A label search in the order of the first cost, with lower bounds from the
    target; a label is dropped when its second cost is no better than what
    already reached its node or the target.
    """
    net = Network.of(arcs, first, second)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        back = net.reverse()
        fans = list(zip(net.head.tolist(), net.costs[0].tolist(), net.costs[1].tolist(), strict=True))
        start = net.first.tolist()
        for b in batches:
            out = []
            for request, source, target in zip(b["request"], b["source"], b["target"], strict=True):
                s, t = net.number(source), net.number(target)
                if s < 0 or t < 0:
                    continue
                h1, h2 = (back.tree(t, which)[0].tolist() for which in (0, 1))
                if not np.isfinite(h1[s]):
                    continue
                least = [np.inf] * len(net.ids)
                heap, number, trail = [(h1[s], h2[s], 0, s, 0.0, 0.0)], 1, [(-1, -1)]
                while heap:
                    _, _, label, v, g1, g2 = heapq.heappop(heap)
                    if g2 >= least[v] or g2 + h2[v] >= least[t]:
                        continue
                    least[v] = g2
                    if v == t:
                        path, at = [], label
                        while at > 0:
                            at, e = trail[at]
                            path.append(int(net.arc[e]))
                        out.append((request, g1, g2, path[::-1]))
                        continue
                    for e in range(start[v], start[v + 1]):
                        w, c1, c2 = fans[e]
                        if g2 + c2 >= least[w] or g2 + c2 + h2[w] >= least[t] or not np.isfinite(h1[w]):
                            continue
                        trail.append((label, e))
                        heapq.heappush(heap, (g1 + c1 + h1[w], g2 + c2 + h2[w], number, w, g1 + c1, g2 + c2))
                        number += 1
            if out:
                yield pd.DataFrame(out, columns=["request", "first", "second", "arcs"])

    return spread(requests, "request").mapInPandas(solve, "request long, first double, second double, arcs array<long>")


def thin(points: DataFrame, most: int = 30) -> DataFrame:
    """At most so many points of each frontier, evenly spread along it by its own length, both ends kept."""
    whole = W.partitionBy("request")
    order = W.partitionBy("request").orderBy("first")
    unit = lambda c: (F.col(c) - F.min(c).over(whole)) / F.greatest(F.max(c).over(whole) - F.min(c).over(whole), F.lit(1e-9))
    rows = points.withColumn("a", unit("first")).withColumn("b", unit("second"))
    rows = rows.withColumn("leg", F.coalesce(F.hypot(F.col("a") - F.lag("a").over(order), F.col("b") - F.lag("b").over(order)), F.lit(0.0)))
    rows = rows.withColumn("at", F.sum("leg").over(order)).withColumn("n", F.count(F.lit(1)).over(whole))
    share = F.col("at") / F.greatest(F.max("at").over(whole), F.lit(1e-9))
    rows = rows.withColumn("slot", F.floor(share * (most - 1) + 0.5)).withColumn("off", F.abs(share * (most - 1) - F.col("slot")))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("request", "slot").orderBy("off", "first")))
    return rows.where((F.col("n") <= most) | (F.col("r") == 1)).select(*points.columns)


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): of each key's values in rising order the one at half their number, rounded down, counted from 0."""
    number = F.row_number().over(W.partitionBy(key).orderBy(value)) - 1
    marked = rows.withColumn("at", number).withColumn("half", F.floor(F.count(F.lit(1)).over(W.partitionBy(key)) / 2))
    return marked.where("at = half").select(key, value)


def round_trips(arcs: DataFrame, requests: DataFrame, tolerance: float = 0.12, most_overlap: float = 0.3, sectors: int = 24, keep: int = 3) -> DataFrame:
    """(request, rank, distance, gain, arcs): loops of about the wished length from a node back to it, flattest first.

    requests is (request, source, wish). From the source's tree, far nodes of
    each compass sector at about a third of the wish are turning points; two of
    them, or one, with the way back penalised for arcs already used, make a
    candidate. Candidates off the wish by more than the tolerance, or that use
    too much of their way twice, are dropped; of those that share most of
    their streets the flatter stays. arcs has cost, gain, x and y of dst.
    """
    net = Network.of(arcs, "cost", "gain")
    spots = arcs.select("dst", "x", "y").distinct().toArrow()  # at most a row an arc, whose number is bounded
    place = dict(zip(spots["dst"].to_pylist(), zip(spots["x"].to_pylist(), spots["y"].to_pylist(), strict=True), strict=True))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xy = np.array([place.get(int(i), (0.0, 0.0)) for i in net.ids])
        for b in batches:
            out = []
            for request, source, wish in zip(b["request"], b["source"], b["wish"], strict=True):
                s = net.number(source)
                if s < 0:
                    continue
                cost, via = net.tree(s, cutoff=0.7 * wish)
                sector = ((np.arctan2(*(xy - xy[s]).T[::-1]) + np.pi) / (2 * np.pi) * sectors).astype(int) % sectors
                turns = []
                for k in range(sectors):
                    for share in (1 / 3, 1 / 2):
                        fit = np.flatnonzero((sector == k) & np.isfinite(cost) & (np.abs(cost - share * wish) < 0.1 * wish))
                        if len(fit):
                            turns.append((k, share, int(fit[np.argmin(np.abs(cost[fit] - share * wish))])))
                tries = [[t] for _, share, t in turns if share == 1 / 2]
                tries += [[t, u] for j, sh, t in turns for k, sk, u in turns if sh == sk == 1 / 3 and 3 <= (k - j) % sectors <= sectors // 3]
                found = []
                for stops in tries:
                    path, at, used = net.path(via, stops[0]), stops[0], set()
                    for goal in [*stops[1:], s]:
                        used.update((int(min(net.tail[e], net.head[e])), int(max(net.tail[e], net.head[e]))) for e in path)
                        leg = _avoiding(net, at, goal, used, wish)
                        if leg is None:
                            break
                        path, at = path + leg, goal
                    else:
                        streets = [(int(min(net.tail[e], net.head[e])), int(max(net.tail[e], net.head[e]))) for e in path]
                        long = net.costs[0][path]
                        once = dict(zip(streets, long, strict=True))
                        total = float(long.sum())
                        if abs(total - wish) <= tolerance * wish and total - sum(once.values()) <= most_overlap * total:
                            found.append((float(net.costs[1][path].sum()), total, once, net.arc[path].tolist()))
                kept = []
                for gain, total, once, path in sorted(found, key=lambda f: (f[0], f[1], f[3])):
                    if len(kept) < keep and all(sum(once[e] for e in once.keys() & k.keys()) <= 0.6 * min(sum(once.values()), sum(k.values())) for k in kept):
                        kept.append(once)
                        out.append((request, len(kept), total, gain, path))
            if out:
                yield pd.DataFrame(out, columns=["request", "rank", "distance", "gain", "arcs"])

    return spread(requests, "request").mapInPandas(solve, "request long, rank int, distance double, gain double, arcs array<long>")


def _avoiding(net: Network, source: int, target: int, used: set[tuple[int, int]], wish: float) -> list[int] | None:
    """Shortest way that counts streets already used three times; None if there is none."""
    first, head, (cost, *_) = net._lists
    best, via, heap = {source: 0.0}, {}, [(0.0, source)]
    done = set()
    while heap:
        d, v = heapq.heappop(heap)
        if v == target:
            out = []
            while v != source:
                out.append(via[v])
                v = int(net.tail[via[v]])
            return out[::-1]
        if v in done or d > 2 * wish:
            continue
        done.add(v)
        for e in range(first[v], first[v + 1]):
            w = head[e]
            new = d + cost[e] * (3 if (min(v, w), max(v, w)) in used else 1)
            if new < best.get(w, np.inf):
                best[w], via[w] = new, e
                heapq.heappush(heap, (new, w))
    return None
