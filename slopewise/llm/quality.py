"""Quality classifier by gated attention over a document's passages.

Multiple-instance learning: only documents carry labels, so each passage is
encoded, a gated attention weighs the passages of a document against each
other, and the label is predicted from their weighted sum. Encoder, attention
and prediction are trained together, by gradients written out in numpy, on a
bounded sample of labelled documents.

A passage is PASSAGE bytes of the text after runs of blanks became one. Its
features are how often each class of character follows each other one, how many
of its words are distinct or repeat the word before, and how long words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewise.llm.common import as_bytes, few_smallest, id_and_bytes, pieces, small_batches
from slopewise.session import cut

PASSAGE = 512
#: Bounds of the training sample: labelled documents, and bytes of their texts together. A document of the sample lends all its passages.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 1 << 24
#: Text is encoded in pieces of about this many bytes, cut at blanks, whatever its length.
PIECE = PASSAGE * 512
THRESHOLD = 0.3

_SETS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b".", b",", b"!", b"?", b"#", b"$", b"%", b"&", b"*", b"|", b"'\"`", b"()[]{}<>", b"-_", b"/\\", b":;", b"@=+~^", bytes(range(128, 256))]
CLASSES = len(_SETS) + 1
_CLASS_OF = np.full(256, CLASSES - 1, np.int64)
for _number, _members in enumerate(_SETS):
    _CLASS_OF[list(_members)] = _number
FEATURES = CLASSES * CLASSES + 5


def _piece_features(words: list[bytes]) -> np.ndarray:
    joined = b" ".join(words)
    classes = _CLASS_OF[np.frombuffer(joined, np.uint8)]
    n = -(-len(joined) // PASSAGE)
    pairs = np.arange(len(joined) - 1) // PASSAGE * (CLASSES * CLASSES) + classes[:-1] * CLASSES + classes[1:]
    counts = np.bincount(pairs, minlength=n * CLASSES * CLASSES).reshape(n, -1).astype(np.float32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    home = (np.cumsum(lengths + 1) - lengths - 1) // PASSAGE
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    held = np.bincount(home, minlength=n).astype(np.float32)
    _, first = np.unique(hashes ^ (home * 0x1E3779B97F4A7C15), return_index=True)
    distinct = np.bincount(home[first], minlength=n)
    again = np.bincount(home[1:][hashes[1:] == hashes[:-1]], minlength=n)
    some = np.maximum(held, 1)
    out = np.empty((n, FEATURES), np.float32)
    out[:, :-5] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    out[:, -5] = distinct / some
    out[:, -4] = again / some
    out[:, -3] = np.minimum(np.bincount(home, weights=lengths, minlength=n) / some / 10, 5)
    out[:, -2] = np.log1p(held) / 5
    out[:, -1] = 1
    return out


def encoded(data: bytes) -> Iterator[np.ndarray]:
    """The passages of a text piece by piece, one row of features for each; a text without words is one passage of zeros."""
    some = False
    for piece in pieces(data, PIECE):
        for at in range(0, len(piece), 4 * PIECE):  # more than once only for words longer than that
            if words := piece[at : at + 4 * PIECE].split():
                some = True
                yield _piece_features(words)
    if not some:
        yield np.zeros((1, FEATURES), np.float32)


def encode(data: bytes) -> np.ndarray:
    return np.concatenate(list(encoded(data)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Encoder w, gates v and u, attention a, prediction c (its last entry is the bias)."""

    w: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """starts: the first passage of each document; passages of a document stand together."""
        sizes = np.diff(np.append(starts, len(x)))
        f = self.passages(x)
        e = np.exp(f["e"] - np.repeat(np.maximum.reduceat(f["e"], starts), sizes))
        weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(f["h"] * weight[:, None], starts)
        return f | {"weight": weight, "z": z, "p": _sigmoid(z @ self.c[:-1] + self.c[-1]), "sizes": sizes}

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the documents, for each parameter."""
        f = self.forward(x, starts)
        up = (f["p"] - labels) / len(labels)
        dz = np.repeat(up, f["sizes"])[:, None] * self.c[:-1]
        through = (f["h"] * dz).sum(1)
        mean = np.repeat(np.add.reduceat(f["weight"] * through, starts), f["sizes"])
        de = f["weight"] * (through - mean)
        dt, ds = de[:, None] * self.a * f["s"] * (1 - f["t"] ** 2), de[:, None] * self.a * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["weight"][:, None] * dz + dt @ self.v.T + ds @ self.u.T) * (1 - f["h"] ** 2)
        return {"w": x.T @ dh, "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de, "c": np.append(f["z"].T @ up, up.sum())}

    def passages(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each passage gives on its own: code h, gates t and s, attention before it is weighed e."""
        h = np.tanh(x @ self.w)
        t, s = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        return {"h": h, "t": t, "s": s, "e": (t * s) @ self.a}

    def score(self, data: bytes) -> float:
        """The score of a text. Its pieces are weighed as they come, against the largest attention so far, so one piece is held at a time."""
        top, total, z = -np.inf, 0.0, np.zeros(len(self.c) - 1)
        for x in encoded(data):
            f = self.passages(x)
            high = max(top, float(f["e"].max()))
            weight = np.exp(f["e"].astype(float) - high)
            again = np.exp(top - high)
            z, total, top = z * again + weight @ f["h"], total * again + weight.sum(), high
        return float(_sigmoid(z / total @ self.c[:-1] + self.c[-1]))


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 12, rate: float = 0.01, seed: int = 7) -> AttentionModel:
    """Adam on the log loss, documents in batches of 64."""
    rng = np.random.default_rng(seed)
    shapes = {"w": (FEATURES, hidden), "v": (hidden, gate), "u": (hidden, gate), "a": (gate,), "c": (hidden + 1,)}
    params = {k: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) for k, s in shapes.items()}
    first, second, step = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            x = np.concatenate([bags[i] for i in batch]).astype(np.float32)
            starts = np.concatenate(([0], np.cumsum([len(bags[i]) for i in batch])[:-1]))
            grads = AttentionModel(**params).gradients(x, starts, labels[batch])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = (params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return AttentionModel(**params)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> AttentionModel | None:
    """Learns from the labelled documents with the smallest hashes of id and text; None if no label is known.

    At most sample_docs documents are taken, in the order of the hash, and of
    these each that the sample's bytes still have room for, whole. labels is
    (doc_id, quality); null labels and ids are left out, and of several labels
    of a document the smallest holds. Rows that repeat an id and a text count
    once; texts that share an id are documents of their own with one label.
    Only numbers come to the driver: a row of features for each passage.
    """
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    some = cut(rows.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).distinct().join(known, "doc_id"))
    drawn = some.where(few_smallest(F.col("h"), sample_docs, F.lit(some.count()))).orderBy("h", "doc_id").limit(sample_docs).collect()
    room, chosen = sample_bytes, {}
    for r in drawn:
        if r["bytes"] <= room:
            room -= r["bytes"]
            chosen[r["doc_id"], r["h"]] = 1.0 if r["quality"] else 0.0
    if not chosen:
        return None
    wanted = docs.sparkSession.createDataFrame(list(chosen), "doc_id long, h long")
    texts = rows.join(F.broadcast(wanted), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [encode(t or b"").astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], ["doc_id", "h", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    bags = texts.select("doc_id", "h", as_bytes(F.col("text")).alias("data")).mapInArrow(features, f"doc_id {kind}, h long, x binary").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    y = np.array([chosen[key] for key in zip(bags["doc_id"].to_pylist(), bags["h"].to_pylist(), strict=True)], np.float32)
    return train([np.frombuffer(x.as_py(), np.float16).reshape(-1, FEATURES) for x in bags["x"]], y)


def score(docs: DataFrame, model: AttentionModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), one row a document, every passage of every text read, a long text piece by piece.

    Null and blank texts are one empty passage. Without a model the score is
    0.5. Repeated rows get equal scores; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_and_bytes(batches):
            scores = [0.5 if model is None else model.score(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes(F.col("text")).alias("data"))
    scored = rows.mapInArrow(compute, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: AttentionModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with the columns they came with, that the model does not reject; the texts are not shuffled."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model is None or model.score(t.as_buffer().to_pybytes() if t.is_valid else b"") >= threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)


def held_out(doc_id, parts: int = 5, part: int = 0):
    """Whether the document belongs to the part that is never learned from; rows without an id are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))
