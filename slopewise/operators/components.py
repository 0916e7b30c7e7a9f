"""Connected components by alternating star contractions.

Each round hangs every node on the smallest neighbour it knows, first from the
side of the larger nodes, then from the side of the smaller ones, so that the
number of rounds grows with the logarithm of a component's size. Edges stay in
distributed tables; a checkpoint after each round cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewise.session import cut


#: Rows of a round's table for each of its files, so that small tables are few files whatever the number of shuffle partitions.
FILE_ROWS = 200_000


def _min_of_neighbours(pairs: DataFrame) -> DataFrame:
    # The key is complemented so that the join below deals both sides anew;
    # adaptive execution can then split the rows of a hub.
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not("a").alias("na"), "m")


def _with_minimum(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("na", F.bitwise_not("a")).join(_min_of_neighbours(pairs), "na")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hung = _with_minimum(both).where("b > a")
    return hung.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    joined = _with_minimum(edges)
    hung = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(_min_of_neighbours(edges).select(F.bitwise_not("na").alias("a"), F.col("m").alias("b")))


def _unfinished(edges: DataFrame) -> bool:
    """True unless each node hangs on one root and no root hangs on a node."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of a link, component being the smallest node reachable.

    Links with a null end and links of a node with itself are left out; links
    may repeat and may stand in either direction. No links give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    stars = cut(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    files = stars.count() // FILE_ROWS + 8  # rounds never add rows
    for _ in range(max_rounds):
        if not _unfinished(stars):
            break
        stars = cut(_small_star(_large_star(stars).distinct()).distinct().coalesce(files))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


#: Links that one task takes at once, as two arrays.
MOST_LINKS = 4_000_000


def network_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """What connected_components gives, where links may well be few: up to MOST_LINKS, which is counted, one task labels them in memory.

    Rounds of joins have dozens of exchanges, and the driver holds a thread and its memory for each.
    """
    pairs = cut(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"))
    if pairs.limit(MOST_LINKS + 1).count() > MOST_LINKS:
        return connected_components(pairs)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if held:
            ids, ends = np.unique(np.concatenate([np.concatenate(side) for side in zip(*held, strict=True)]), return_inverse=True)
            left, right = np.split(ends, 2)
            root = np.arange(len(ids))
            while True:
                low = np.minimum(root[left], root[right])
                new = root.copy()
                for side in (left, right):  # the root of each end hangs on the smaller one
                    np.minimum.at(new, root[side], low)
                while (new[new] != new).any():
                    new = new[new]
                if (new == root).all():
                    break
                root = new
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["node", "component"])

    return pairs.coalesce(1).mapInArrow(label, "node long, component long")
