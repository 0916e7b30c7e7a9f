"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by the
order in which it sees the pivots, nearest first, and is posted in the inverted
files of its first pivots. A query reads the files of its own first pivots,
ranks what it finds by the footrule distance of the two orders, and measures
the nearest exactly.

A file is a group of rows, (pivot, part): a file of many postings is cut into
parts by a hash, and its queries into chunks, so no task holds more than a part
and a chunk. Two orders may meet in several files; they are compared in the
file of the query's nearest pivot among them. How near is near enough for a
query comes from its footrule distances to a bounded sample: of the table,
about NEAR * sqrt(n) entries are nearer than that. The number of pivots grows
with sqrt(n) as well, so the work for a query grows far slower than the table.

Equal vectors are one entry of the index and carry the smallest ids among them,
one more than are asked for, so that a vector that very many rows repeat costs
one comparison. Vectors of each length are an index of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopewise.llm.common import few_smallest
from slopewise.session import cut

#: Files under which a vector is posted, and files that a query reads.
POSTED, PROBED = 8, 32
#: Pivots for a table of n vectors: PER_ROOT * sqrt(n), but within these bounds, the pivots that order vectors, and vectors of the sample.
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS, ORDERING, SAMPLED = 2.2, 256, 16384, 512, 2048
#: How alike two pivots may be while there are others.
ALIKE = 0.8
#: Entries that are measured for a query, of n: about NEAR * sqrt(n).
NEAR = 4.0
#: Postings of a file's part, and queries of a chunk.
PART, CHUNK = 4096, 4096
OUT = "query_id long, vec_id long, score double, measured long"


def usable(embedding: Column) -> Column:
    """True for vectors without null or non-finite components of which one is not zero."""
    x = embedding.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))).astype(np.float32)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Product over the product of the lengths, in double precision; where that leaves the range of doubles, of the vectors scaled by their largest components."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        lengths = np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum())
        found = vectors @ query / lengths
    odd = ~(np.isfinite(found) & (lengths > 1e-280) & (lengths < 1e280))
    if odd.any():
        a, b = vectors[odd] / np.abs(vectors[odd]).max(1, keepdims=True), query / np.abs(query).max()
        found[odd] = a @ b / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum()))
    return found


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def choose_pivots(units: np.ndarray, most: int) -> np.ndarray:
    """The first vectors that are not too like an earlier choice; others fill up. Near copies as pivots would tell nothing."""
    chosen: list[int] = []
    for at in range(len(units)):
        if len(chosen) < most and (not chosen or (units[chosen] @ units[at]).max() < ALIKE):
            chosen.append(at)
    taken = set(chosen)
    return units[chosen + [at for at in range(len(units)) if at not in taken][: most - len(chosen)]]


def footrule(places: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Footrule distance of each order to one; the rows given are used up."""
    np.subtract(places, own, out=places)
    return np.abs(places, out=places).sum(1, dtype=np.int32)


@dataclass
class Pivots:
    """The pivots for vectors of one length. The first ORDERING of them order vectors; all have inverted files."""

    units: np.ndarray
    sample: np.ndarray
    near: float

    def first(self, units: np.ndarray, count: int) -> np.ndarray:
        """Numbers of the nearest pivots of each vector, nearest first."""
        rows = max(1, (1 << 22) // len(self.units))
        return np.concatenate([np.argsort(-(units[at : at + rows] @ self.units.T), axis=1, kind="stable")[:, :count].astype(np.int32) for at in range(0, len(units), rows)])

    def places(self, units: np.ndarray) -> np.ndarray:
        """The place of each ordering pivot in the order of each vector."""
        ordering = self.units[:ORDERING]
        order = np.argsort(-(units @ ordering.T), axis=1)  # pivots that are equally far stand in any order
        place = np.empty(order.shape, np.int16)
        np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
        return place

    def radius(self, units: np.ndarray) -> np.ndarray:
        """For each vector the footrule distance within which the nearest share of the sample lies."""
        known, rank = self.places(self.sample), min(len(self.sample), max(1, round(self.near * len(self.sample)))) - 1
        own = self.places(units)
        return np.array([np.partition(footrule(known.copy(), p), rank)[rank] for p in own], np.int32)


def learn(entries: DataFrame, per_root: float = PER_ROOT, least: int = LEAST_PIVOTS, most: int = MOST_PIVOTS, sampled: int = SAMPLED, near: float = NEAR) -> dict[int, Pivots]:
    """Pivots for each length of the entries' vectors v, from those with the smallest hashes.

    The sample of all lengths together is bounded by the largest number of
    pivots; the more lengths there are, the fewer vectors each has, but two.
    """
    counts = {r["d"]: r["n"] for r in entries.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    room = max(2, most // max(1, len(counts)))
    wanted = {d: (min(n, room, max(least, round(per_root * n**0.5))), n) for d, n in counts.items()}
    sizes = entries.sparkSession.createDataFrame([(d, min(n, max(sampled, 2 * p) if room >= sampled else room), n) for d, (p, n) in wanted.items()], "d int, take long, n long")
    hashed = entries.select("v", F.size("v").alias("d"), F.xxhash64("v").alias("h")).join(F.broadcast(sizes), "d")
    some = hashed.where(few_smallest(F.col("h"), F.col("take"), F.col("n"))).withColumn("r", F.row_number().over(W.partitionBy("d").orderBy("h", "v"))).where(F.col("r") <= F.col("take"))
    found = some.select("d", "r", "v").toArrow().sort_by([("d", "ascending"), ("r", "ascending")])
    out = {}
    for d in sorted(counts):
        units = unit(_matrix(found.filter(pc.equal(found["d"], d))["v"], d))
        out[d] = Pivots(choose_pivots(units, wanted[d][0]), units[:sampled], min(1.0, near / wanted[d][1] ** 0.5))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", posted: int = POSTED, probed: int = PROBED, near: float = NEAR, part: int = PART, chunk: int = CHUNK, per_root: float = PER_ROOT, least_pivots: int = LEAST_PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score, measured): the k vectors found nearest to each query by cosine, its own id left out.

    Ties go to the smaller id. Vectors and queries that are null or zero, hold
    null or non-finite components or have no id take no part; queries meet the
    vectors of their own length. An id that stands for several vectors counts
    with its best score; as a query it asks with the smallest of them. Repeated
    rows count once. Fewer vectors than k give fewer ranks, empty tables no
    rows. measured is the number of vectors measured exactly for the query.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    smallest = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    ranked = pick(vectors).distinct().withColumn("r", smallest).where(F.col("r") <= k + 1)
    entries = cut(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = cut(pick(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    model = learn(entries, per_root, least_pivots, near=near)
    if not model:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, measured long")
    asked = asked.where(F.size("v").isin(list(model)))

    def with_pivots(count: int, radius: bool):
        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
                for d in map(int, np.unique(dims)):
                    own = batch.filter(pa.array(dims == d))
                    units = unit(_matrix(own.column("v"), d))
                    first = pa.array(list(model[d].first(units, count)), pa.list_(pa.int32()))
                    more = [pa.array(model[d].radius(units))] if radius else []
                    yield pa.RecordBatch.from_arrays([*own.columns, first, *more], [*own.schema.names, "pivots", *(["radius"] if radius else [])])

        return compute

    kind = dict(vectors.dtypes)[vector_col]
    posts = entries.mapInArrow(with_pivots(posted, False), f"v {kind}, ids array<long>, pivots array<int>")
    probes = asked.select("v", F.col("vec_id").alias("query_id")).mapInArrow(with_pivots(probed, True), f"v {kind}, query_id long, pivots array<int>, radius int")
    posts = cut(posts.withColumn("d", F.size("v")))
    probes = cut(probes.withColumn("d", F.size("v")))
    # Postings and probes of each file, one row a pivot; both sides are cut by hashes, so that a task that runs again deals alike.
    file = ["d", "pivot"]
    lengths = posts.select("d", F.explode("pivots").alias("pivot")).groupBy(*file).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    read = probes.select("d", F.explode("pivots").alias("pivot")).groupBy(*file).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    files = F.broadcast(cut(lengths.join(read, file)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posts.withColumn("pivot", F.explode("pivots")).join(files, file).withColumn("part", F.pmod(F.xxhash64(F.xxhash64("v")), F.col("parts")).cast("int")).withColumn("chunk", every("chunks"))
    right = probes.withColumn("pivot", F.explode("pivots")).join(files, file).withColumn("chunk", F.pmod(F.xxhash64(F.xxhash64("query_id")), F.col("chunks")).cast("int")).withColumn("part", every("parts"))
    group = ["d", "pivot", "part", "chunk"]

    def meet(key: tuple, entries: pa.Table, asked: pa.Table) -> pa.Table:
        d, pivot = key[0].as_py(), key[1].as_py()
        out: list[tuple[int, int | None, float | None, int]] = []
        if len(entries) and len(asked):
            pivots = model[d]
            held, sought = _matrix(entries["v"], d), _matrix(asked["v"], d)
            places, own_places = pivots.places(unit(held)), pivots.places(unit(sought))
            under = np.array(entries["pivots"].to_pylist(), np.int32)
            ids = entries["ids"].to_pylist()
            own_pivots, radius = asked["pivots"].to_pylist(), asked["radius"].to_numpy()
            for q, own in enumerate(asked["query_id"].to_pylist()):
                # Entries that are posted under an earlier pivot of the query were met there.
                earlier = np.zeros(len(pivots.units), bool)
                earlier[own_pivots[q][: own_pivots[q].index(pivot)]] = True
                found = np.flatnonzero(~earlier[under].any(1))
                found = found[footrule(places[found], own_places[q]) <= radius[q]]
                if len(found):
                    score = cosines(held[found], sought[q])
                    bound = np.partition(score, -min(k + 1, len(score)))[-min(k + 1, len(score))]
                    nearest = sorted((-s, i) for e, s in zip(found[score >= bound], score[score >= bound], strict=True) for i in ids[e] if i != own)[:k]
                    out += [(own, i, -s, 0) for s, i in nearest] + [(own, None, None, len(found))]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], names=["query_id", "vec_id", "score", "measured"])

    found = left.select(*group, "v", "ids", "pivots").groupBy(*group).cogroup(right.select(*group, "v", "query_id", "pivots", "radius").groupBy(*group)).applyInArrow(meet, OUT)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("measured").alias("measured"))
    own = W.partitionBy("query_id")
    best = best.withColumn("rank", F.row_number().over(own.orderBy(F.col("score").desc_nulls_last(), "vec_id"))).withColumn("measured", F.sum("measured").over(own))
    return best.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "measured")
