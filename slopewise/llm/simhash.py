"""SimHash near-duplicates, linked by a pigeonring filter.

A fingerprint's 64 bits stand on a ring of eight segments. If two fingerprints
differ in at most three bits, some segment starts a chain along which the
differences of the first l segments are at most 3 l / 8, for every l from 1 to
8. So from that start two segments (16 bits) are equal and the next three
differ in at most one bit, which leaves one of their 12-bit halves equal. The
start, the half and those 28 equal bits form a key; each fingerprint has 16.
Only fingerprints with a common key are compared, first along the chain, then
in full.

Equal fingerprints are one node from the beginning. Among the nodes of a key a
spanning forest of the links is emitted rather than all pairs: that keeps all
that can be reached and stays linear in the nodes. Keys with more than BLOCK
nodes are dealt out as pairs of blocks, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopewise.llm.common import as_bytes, broadcast_if_small, id_and_bytes, pieces, small_batches
from slopewise.operators.components import network_components
from slopewise.session import cut

SEED = 42
DISTANCE = 3
SEGMENTS = 8
#: Nodes of one key that a task takes at once.
BLOCK = 4096
#: Groups up to this size are compared pair by pair, larger ones by search.
SMALL = 24
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def simhash(data: bytes, width: int = 3) -> int:
    """The fingerprint of one text as an unsigned 64-bit number; 0 if it has no word."""
    counts, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    held: list[bytes] = []
    for piece in pieces(data):
        words = held + piece.lower().split()  # for bytes: A-Z only, and exactly the six ASCII blanks
        held = words[-(width - 1) :] if width > 1 else []
        if len(words) < width:
            held = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        ends = ends[width - 1 :].tolist()
        total += len(starts)
        for at in range(0, len(starts), CHUNK):
            hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], dtype="<u8")
            bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
            counts += bits.sum(axis=0, dtype=np.int32)
    if not total:  # fewer words than a shingle has: the whole sequence is one
        return digest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row a document; the 64 bits of fp are held in a signed long. A null text counts as an empty one."""
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_and_bytes(batches):
            prints = np.array([simhash(t or b"", width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("data"))
    return rows.mapInArrow(compute, "doc_id long, fp long")


def _rotated(fp: Column, start: int) -> Column:
    bits = start * 64 // SEGMENTS
    return fp if not bits else F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, 64 - bits))


def ring_keys(fp: Column) -> Column:
    """The sixteen keys: start and half in the upper bits, then the equal bits."""
    keys = []
    for start in range(SEGMENTS):
        turned = _rotated(fp, start)
        for half in range(2):
            bits = F.shiftrightunsigned(turned, 16 + 12 * half).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((start * 2 + half) << 28).bitwiseOR(F.shiftleft(turned.bitwiseAND(F.lit(0xFFFF)), 12)).bitwiseOR(bits))
    return F.array(*keys)


#: Chain lengths at which the budget 3 l / 8 last holds its value, as masks over the turned difference.
_CHAIN = [(np.uint64((1 << (8 * length)) - 1), length * DISTANCE // SEGMENTS) for length in (2, 5, 7)]


def _linked(diff: np.ndarray, turn: np.ndarray | int) -> np.ndarray:
    """Which differences stay within the chain's budgets from the segment that starts at bit turn, then pass the full check."""
    turn = np.uint64(turn) if np.isscalar(turn) else turn.astype(np.uint64)
    back = (np.uint64(64) - turn) & np.uint64(63)
    turned = (diff >> turn) | np.where(back == 0, np.uint64(0), diff << back)
    keep = np.ones(len(diff), bool)
    for mask, most in _CHAIN:
        keep &= np.bitwise_count(turned & mask) <= most
    return keep & (np.bitwise_count(diff) <= DISTANCE)


def _links(key: np.ndarray, group: np.ndarray, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each group of rows; the rows of a group stand together."""
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(group)))
    of = np.repeat(np.arange(len(start)), size)
    turn = (key >> 29) * 8
    a, b = [], []
    small = size[of] <= SMALL
    for step in range(1, min(SMALL, int(size.max(initial=0)))):
        left = np.flatnonzero((of[:-step] == of[step:]) & small[:-step])
        hit = left[_linked(fp[left] ^ fp[left + step], turn[left])]
        a.append(node[hit])
        b.append(node[hit + step])
    for g in np.flatnonzero(size > SMALL):
        rest = np.arange(start[g], start[g] + size[g])
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                one = queue.pop()
                near = _linked(fp[rest] ^ fp[one], int(turn[one]))
                hit, rest = rest[near], rest[~near]
                a.append(np.full(len(hit), node[one]))
                b.append(node[hit])
                queue.extend(hit)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among sorted rows (key, i, j, fp, node); the last group of a batch waits for the next."""
    held: list[np.ndarray] | None = None

    def links(columns: list[np.ndarray], upto: int) -> pa.RecordBatch:
        key, i, j, fp, node = (c[:upto] for c in columns)
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        a, b = _links(key, np.cumsum(new), fp.view(np.uint64), node)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        last = np.logical_and.reduce([c == c[-1] for c in columns[:3]])
        upto = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if upto:
            yield links(columns, upto)
        held = [c[upto:] for c in columns]
    if held is not None and len(held[0]):
        yield links(held, len(held[0]))


def link_fingerprints(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs within the distance would; nodes has distinct (fp, node)."""
    keyed = nodes.select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp", "node")
    large = keyed.groupBy("key").count().where(F.col("count") > BLOCK)
    large = large.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "node")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_search, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), one row a document.

    component_id is the smallest doc_id reachable over links of at most three
    differing bits, itself included. Null and empty texts have fingerprint 0,
    which links like any other. Rows that share a doc_id are one node. A row
    with a null doc_id gets its fingerprint, takes no part in links and has a
    null component_id. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    known = prints.where(F.col("doc_id").isNotNull())
    nodes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("node")))
    # A doc_id with several texts holds their fingerprints together.
    repeated = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    links = link_fingerprints(nodes)
    if not repeated.isEmpty():
        bound = known.join(nodes, "fp").select("doc_id", "node").distinct()
        links = links.unionByName(bound.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    found = network_components(links)
    small_batches(docs.sparkSession)
    labelled = nodes.join(found, "node", "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id"))
    joined = prints.join(labelled, prints["fp"] == labelled["of"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def joined(groups: DataFrame, others: DataFrame) -> DataFrame:
    """(doc_id, component_id), one row for each of groups: groups of either kind that share a document are one, named by its smallest doc_id.

    Both are (doc_id, component_id) of the same documents, each group named by its smallest doc_id.
    """
    groups = cut(groups.select("doc_id", "component_id"))
    known = groups.where("doc_id is not null").distinct()
    to = others.where("doc_id is not null").select("doc_id", F.col("component_id").alias("to")).distinct()
    met = known.join(to, "doc_id").where("component_id <> to").select("component_id", "to").distinct()
    found = broadcast_if_small(cut(network_components(met, "component_id", "to")))
    return groups.join(found, groups["component_id"] == found["node"], "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each_group(docs: DataFrame, width: int = 3, groups: DataFrame | None = None) -> DataFrame:
    """The documents, with the columns they came with, that have the smallest doc_id of their group.

    The groups, (doc_id, component_id), are those of near_duplicates unless others are given. Rows that repeat such a doc_id give one row, that with the smallest text;
    rows without an id stay.
    """
    found = cut((near_duplicates(docs, width=width) if groups is None else groups).select("doc_id", "component_id"))
    # A document goes if its group has a smaller id; those that go are fewer than those that stay, as a rule.
    gone = broadcast_if_small(found.where("doc_id <> component_id").select("doc_id").distinct())
    left = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    again = cut(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id")))
    if again.isEmpty():
        return left
    again = broadcast_if_small(again)
    # The rows are structs here, so that no column of theirs can clash with those of this step; equal texts are one before they meet.
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    of = F.col("row.doc_id") == F.col("id")
    first = rows.join(again, of, "left_semi").groupBy(F.col("row.doc_id").alias("of")).agg(F.min_by("row", F.struct(F.col("row.text").isNotNull(), F.col("row.text"), F.xxhash64("row"))).alias("row"))
    return rows.join(again, of, "left_anti").select("row.*").unionByName(first.select("row.*"))
