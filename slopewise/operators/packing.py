"""Compact export of a network: keys, codes and byte bundles."""

from __future__ import annotations

import base64
import gzip
import itertools
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopewise.session import cut, fresh_path, opened

TYPES = {"u1": "<u1", "u2": "<u2", "i2": "<i2", "u4": "<u4", "i4": "<i4", "f4": "<f4"}


def quantise(value: Column, scale: float, low: int = 0, high: int = 65535) -> Column:
    """value * scale, rounded half to even and held to the range."""
    return F.least(F.greatest(F.bround(value * scale).cast("long"), F.lit(low)), F.lit(high))


def bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    """How many bounds the value has reached."""
    total = F.lit(0)
    for b in bounds:
        total = total + F.when(value >= b, 1).otherwise(0)
    return total


def bits(*flags: Column) -> Column:
    total = F.lit(0)
    for k, f in enumerate(flags):
        total = total.bitwiseOR(F.when(f, 1 << k).otherwise(0))
    return total


def numbered(values: DataFrame, column: str, number: str, start: int = 0) -> DataFrame:
    """The distinct values of a one-column table with their place in order; ranges of values are counted first, so no task sees them all."""
    ranges = cut(values.distinct().repartitionByRange(F.col(column))).withColumn("range", F.spark_partition_id())
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    base = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("range").orderBy(column))
    return ranges.withColumn("at", inside).join(F.broadcast(base), "range").select(column, (F.col("base") + F.col("at") + (start - 1)).alias(number))


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(column, number): distinct values in order from 1; null and empty ones are 0 and not listed."""
    return numbered(rows.where(F.coalesce(column, F.lit("")) != "").select(column), column, "number", 1)


def row_pointers(arcs: DataFrame, nodes: DataFrame, stretch: int = 4096) -> DataFrame:
    """(node, degree, first): where the arcs of each node begin when they are sorted by node.

    Degrees are added up over ranges of nodes first, so the running sum needs
    no single task for all nodes; nodes are numbered from 0.
    """
    counts = nodes.select("node").join(arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    counts = counts.withColumn("range", F.floor(F.col("node") / stretch))
    ranges = counts.groupBy("range").agg(F.sum("degree").alias("s"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("range").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("upto", F.coalesce(F.sum("degree").over(inside), F.lit(0))).join(ranges, "range").select("node", "degree", (F.col("base") + F.col("upto")).alias("first"))


def deltas(rows: DataFrame, key: str, order: str, value: str, modulus: int = 65536) -> DataFrame:
    """(key, order, delta): differences to the row before, wrapped into the unsigned range."""
    w = W.partitionBy(key).orderBy(order)
    return rows.select(key, order, F.pmod(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)), F.lit(modulus)).alias("delta"))


def encode_line(points: list[tuple[float, float]], precision: int = 5) -> str:
    """Polyline text of (x, y) points, y first, rounded half to even."""
    out, held = [], [0, 0]
    for x, y in points:
        for k, v in enumerate((y, x)):
            whole = int(np.rint(v * 10**precision))
            d, held[k] = whole - held[k], whole
            d = ~(d << 1) if d < 0 else d << 1
            while d >= 0x20:
                out.append(chr((0x20 | (d & 0x1F)) + 63))
                d >>= 5
            out.append(chr(d + 63))
    return "".join(out)


def decode_line(code: str, precision: int = 5) -> list[tuple[float, float]]:
    values, shift, number = [], 0, 0
    for c in code:
        chunk = ord(c) - 63
        number |= (chunk & 0x1F) << shift
        shift += 5
        if chunk < 0x20:
            values.append(~(number >> 1) if number & 1 else number >> 1)
            shift = number = 0
    ys, xs = np.cumsum(values[0::2]), np.cumsum(values[1::2])
    return [(float(x) / 10**precision, float(y) / 10**precision) for x, y in zip(xs, ys, strict=True)]


def _encoded(kind: str, values: np.ndarray, differ: bool) -> bytes:
    if differ:
        values = np.diff(values, prepend=0)
    return np.asarray(values).astype(np.int64 if kind[0] != "f" else np.float64, copy=False).astype(TYPES[kind]).tobytes()


def _head(arrays: dict[str, tuple[str, int, bool]], strings: dict[str, list[str]]) -> bytes:
    """The manifest, its length before it, of arrays that follow each other; each is (type, length, whether differences are stored)."""
    manifest, at = {"strings": strings, "arrays": {}}, 0
    for name, (kind, many, differ) in arrays.items():
        if kind not in TYPES:
            raise TypeError(f"unknown type {kind!r} of {name}")
        manifest["arrays"][name] = {"t": kind, "o": at, "n": many} | ({"d": 1} if differ else {})
        at += many * np.dtype(TYPES[kind]).itemsize
    head = json.dumps(manifest, sort_keys=True).encode()
    return len(head).to_bytes(4, "little") + head


def bundle(arrays: dict[str, tuple[str, np.ndarray, bool]], strings: dict[str, list[str]]) -> str:
    """Base64 text of a gzip file: a manifest, then the arrays; each is (type, values, whether differences are stored)."""
    head = _head({name: (kind, len(values), differ) for name, (kind, values, differ) in arrays.items()}, strings)
    return base64.b64encode(gzip.compress(head + b"".join(_encoded(*a) for a in arrays.values()), mtime=0)).decode()


def _write(out: BinaryIO, pieces: Iterator[bytes]) -> None:
    """What bundle does with a head and encoded arrays, piece by piece into a file."""
    squeeze, held = zlib.compressobj(9, wbits=31), b""
    for piece in pieces:
        held += squeeze.compress(piece)
        whole = len(held) - len(held) % 3
        out.write(base64.b64encode(held[:whole]))
        held = held[whole:]
    out.write(base64.b64encode(held + squeeze.flush()))


def unbundle(packed: str | bytes) -> tuple[dict[str, np.ndarray], dict[str, list[str]]]:
    data = gzip.decompress(base64.b64decode(packed))
    size = int.from_bytes(data[:4], "little")
    manifest, body = json.loads(data[4 : 4 + size]), data[4 + size :]
    out = {}
    for name, m in manifest["arrays"].items():
        values = np.frombuffer(body, TYPES[m["t"]], m["n"], m["o"])
        out[name] = np.cumsum(values, dtype=values.dtype) if m.get("d") else values
    return out, manifest["strings"]


MOST_EDGES = 5_000_000


def _places(known: np.ndarray, order: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Where in the order ids stand; all must be known."""
    by = np.argsort(known)
    ids, place = known[by], np.empty(len(known), np.int32)
    place[order] = np.arange(len(known), dtype=np.int32)
    place = place[by]

    def find(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ids, wanted)
        if len(wanted) and (not len(ids) or (ids[np.minimum(at, len(ids) - 1)] != wanted).any()):
            raise ValueError("an arc's end or street is not in the network")
        return place[at]

    return find


def _pack(folder: str) -> str:
    """Packs the tables in the folder, a column at a time, into a file there that no other attempt shares; its path."""
    store, at = opened(folder)
    column = lambda table, name: pq.read_table(f"{at}/{table}", columns=[name], filesystem=store, use_threads=False)[name]
    number = lambda table, name: column(table, name).to_numpy()

    def words(name: str) -> tuple[list[str], np.ndarray]:
        coded = pc.fill_null(column("streets", name), "").dictionary_encode().unify_dictionaries().combine_chunks()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy()

    node = number("corners", "node")
    corners = np.lexsort((node, number("corners", "k")))
    place = _places(node, corners)
    edge = number("streets", "edge_id")
    streets = np.argsort(edge, kind="stable")
    start = place(number("ways", "src"))
    ways = np.lexsort((number("ways", "arc_id"), start))
    first = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(corners)))])
    (spelled, name), (classes, cls) = words("name"), words("cls")
    names, ranked = sorted(n for n in spelled if n), sorted(classes)
    of = {n: i + 1 for i, n in enumerate(names)}
    name, cls = np.array([of.get(n, 0) for n in spelled], np.int64)[name], np.array([ranked.index(c) for c in classes], np.int64)[cls]
    # Encoded one after the other, so that only one of the long columns is held.
    arrays = {
        **{c: ("i4", len(corners), True, lambda c=c: number("corners", c)[corners]) for c in "xyz"}, "first": ("u4", len(first), True, lambda: first),
        "head": ("u4", len(ways), False, lambda: place(number("ways", "dst"))[ways]), "edge": ("u4", len(ways), False, lambda: _places(edge, streets)(number("ways", "edge_id"))[ways]),
        "gain": ("u4", len(ways), False, lambda: number("ways", "gain")[ways]), "flags": ("u1", len(ways), False, lambda: number("ways", "flags")[ways]),
        "len": ("u4", len(streets), False, lambda: number("streets", "len")[streets]), "name": ("u2", len(streets), False, lambda: name[streets]), "cls": ("u1", len(streets), False, lambda: cls[streets]),
    }
    path = f"{folder}/{uuid.uuid4().hex}.b64"
    with store.open_output_stream(opened(path)[1]) as out:
        head = _head({k: a[:3] for k, a in arrays.items()}, {"names": names, "classes": ranked})
        _write(out, itertools.chain([head], (_encoded(kind, values(), differ) for kind, _, differ, values in arrays.values())))
    return path


def pack_network(nodes: DataFrame, edges: DataFrame, arcs: DataFrame) -> str:
    """The path, in the shared folder, of the network's bundle: corners in Z-order, arcs sorted by corner, attributes of edges, names once.

    The bundle is one file for a browser, so the network must be small, which
    is checked. One task packs it; it never passes through the driver.
    """
    from slopewise.functions.geometry import morton

    spark = edges.sparkSession
    folder = fresh_path(spark, "bundle")
    edges.select("edge_id", "len", "name", "cls").write.parquet(f"{folder}/streets")
    if spark.read.parquet(f"{folder}/streets").count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges")
    nodes.select("node", "x", "y", "z", morton(F.col("col"), F.col("row")).alias("k")).write.parquet(f"{folder}/corners")
    arcs.select("arc_id", "edge_id", "src", "dst", "gain", bits(F.col("walk"), F.col("bike"), F.col("direction") == "rev").alias("flags")).write.parquet(f"{folder}/ways")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(x) for x in batch.column(0).to_pylist()], pa.string())], ["path"])

    return spark.range(1, numPartitions=1).select(F.lit(folder).alias("folder")).mapInArrow(pack, "path string").first().path


def read_bundle(path: str) -> tuple[dict[str, np.ndarray], dict[str, list[str]]]:
    """What unbundle gives for a file of pack_network, on a worker or wherever its folder is seen."""
    store, at = opened(path)
    with store.open_input_stream(at) as text:
        return unbundle(text.read())
