"""Near-duplicates by the Jaccard similarity of word shingles, confirmed exactly.

Texts with the same set of shingles are one node from the beginning. Each
node's set gives BANDS keys, each of ROWS minima over permutations; sets of
similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, 0.99998 at
0.8 and more above. Nodes that hang together by keys, which one link a node and
key tells, form a candidate group; every pair that shares a key lies in one.
Only the sets of candidates are shuffled, once for each block they meet. Inside
a group the similarity of a pair is counted on the sets, over an inverted index
of the nodes not yet reached, and a spanning forest of the links is emitted.
Groups with more than BLOCK nodes or BLOCK_SHINGLES shingles are dealt out as
pairs of blocks, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewise.llm.common import as_bytes, broadcast_if_small, id_and_bytes, pieces, small_batches
from slopewise.operators.components import network_components
from slopewise.session import cut

WIDTH, SIMILAR = 5, 0.8
SEED = 42
BANDS, ROWS = 28, 5
#: Nodes, and shingles of nodes, of one group that a task takes at once; it holds two such blocks.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Shingles that are hashed, and whose minima are taken, at once.
CHUNK = 1 << 12

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The hashes of the different shingles, in order. Of fewer words than a shingle has, the whole sequence is one; no word gives none."""
    digest, found = xxhash.xxh64_intdigest, []
    held: list[bytes] = []
    for piece in pieces(data):
        words = held + piece.lower().split()  # for bytes: A-Z only, and exactly the six ASCII blanks
        held = words[-(width - 1) :] if width > 1 else []
        if len(words) < width:
            held = words
            continue
        found.append(np.fromiter((digest(b" ".join(words[k : k + width]), SEED) for k in range(len(words) - width + 1)), np.uint64, len(words) - width + 1))
    if not found:
        return np.array([digest(b" ".join(held), SEED)] if held else [], np.uint64)
    return np.unique(np.concatenate(found))


def band_keys(own: np.ndarray) -> list[int]:
    """One key a band; none for an empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK):
        least = np.minimum(least, (own[at : at + CHUNK] * _FACTORS + _SHIFTS).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def _set_key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, key, n, bands): key names the set, n is its size."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_and_bytes(batches):
            sets = [shingles(t or b"", width) for t in texts]
            keys = np.array([_set_key(s) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), bands], ["doc_id", "key", "n", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("data"))
    return rows.mapInArrow(compute, "doc_id long, key long, n long, bands array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(key, shingles): the sets themselves, eight bytes a shingle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in id_and_bytes(batches):
            sets = [shingles(t or b"", width) for t in texts]
            keys = np.array([_set_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("data"))
    return rows.mapInArrow(compute, "key long, shingles binary")


def _index(sets: list[np.ndarray], rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles of the rest, where the owners of each begin, and the owners."""
    every = np.concatenate([sets[r] for r in rest])
    owners = np.repeat(rest, [len(sets[r]) for r in rest])
    order = np.argsort(every, kind="stable")
    known, begin = np.unique(every[order], return_index=True)
    return known, np.append(begin, len(every)), owners[order]


def forest(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Links between places in the list that join the same sets as all pairs of at least the similarity would."""
    size = np.array([len(s) for s in sets], np.int64)
    todo = np.ones(len(sets), bool)
    links: list[tuple[int, int]] = []
    indexed, (known, begin, owners) = len(sets), _index(sets, np.arange(len(sets)))
    for first in range(len(sets)):
        if not todo[first]:
            continue
        todo[first] = False
        queue = [first]
        while queue and todo.any():
            if 2 * todo.sum() < indexed:
                rest = np.flatnonzero(todo)
                indexed, (known, begin, owners) = len(rest), _index(sets, rest)
            one = queue.pop()
            at = np.searchsorted(known, sets[one])
            at = at[known[np.minimum(at, len(known) - 1)] == sets[one]]
            if not len(at):
                continue
            length = begin[at + 1] - begin[at]
            spots = np.repeat(begin[at] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            shared = np.bincount(owners[spots], minlength=len(sets))
            hit = np.flatnonzero(todo & (shared / np.maximum(size + size[one] - shared, 1) >= similar))
            todo[hit] = False
            links += [(one, h) for h in hit.tolist()]
            queue.extend(hit.tolist())
    return links


def _search(similar: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links among sorted rows (part, i, j, node, shingles), group by group."""
        of, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = forest(sets, similar)
            return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in found], pa.int64()), pa.array([nodes[b] for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            parts, i, j, ids = (c.to_pylist() for c in batch.columns[:4])
            for k in range(batch.num_rows):
                if (parts[k], i[k], j[k]) != of:
                    if len(sets) > 1:
                        yield links()
                    of, nodes, sets = (parts[k], i[k], j[k]), [], []
                nodes.append(ids[k])
                sets.append(np.frombuffer(batch.column(4)[k].as_py(), np.uint64))
        if len(sets) > 1:
            yield links()

    return search


def similar_links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int, similar: float) -> DataFrame:
    """Links (a, b) that join the same nodes as all similar pairs would; nodes has distinct (key, node, n, bands)."""
    keyed = nodes.select(F.explode("bands").alias("band"), "node", "key")
    shared = keyed.groupBy("band").agg(F.min(F.struct("node", "key")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    # The key is complemented so that the join deals both sides anew and a hot one can be split.
    shared = shared.select(F.bitwise_not("band").alias("nband"), F.col("first.key").alias("to"))
    met = keyed.withColumn("nband", F.bitwise_not("band")).join(shared, "nband").where("key <> to").select("key", "to").distinct()
    group = network_components(met, "key", "to").withColumnsRenamed({"node": "key", "component": "part"})
    group = cut(group.join(nodes.select("key", "node", "n"), "key"))
    sizes = group.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    large = broadcast_if_small(cut(sizes.where("blocks > 1")))
    wanted = broadcast_if_small(cut(group.select(F.col("node").alias("__node")).distinct()))
    small_batches(docs.sparkSession)
    few = docs.join(wanted, docs[id_col].cast("long") == wanted["__node"], "left_semi")
    held = group.join(_sets(few, id_col, text_col, width).dropDuplicates(["key"]), "key").join(large, "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = held.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")
    return dealt.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(_search(similar), "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id), one row a document.

    component_id is the smallest doc_id reachable over links of at least the
    similarity, itself included. Null and empty texts have the empty set, and
    equal sets are linked. Rows that share a doc_id are one node. A row with a
    null doc_id takes no part in links and has a null component_id. An empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    signed = cut(_signatures(docs, id_col, text_col, width))
    known = signed.where(F.col("doc_id").isNotNull())
    nodes = cut(known.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    # A doc_id with several texts holds their sets together.
    repeated = known.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    links = similar_links(docs, nodes, id_col, text_col, width, similar)
    if not repeated.isEmpty():
        bound = known.join(nodes.select("key", "node"), "key").select("doc_id", "node").distinct()
        links = links.unionByName(bound.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    found = network_components(links)
    labelled = nodes.join(found, "node", "left").select(F.col("key").alias("of"), F.coalesce("component", "node").alias("component_id"))
    joined = signed.select("doc_id", "key").join(labelled, F.col("key") == labelled["of"], "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
