"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an
offset and a stride drawn from its name. The shards take turns; at its turn a
shard claims the first slot of its permutation that is still free. Shards so
hold equal shares up to one slot, and when a shard leaves, few slots of the
others change hands. The table's size is a parameter and does not depend on
the data, so it is broadcast; a row's slot is a hash of its key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, about a thousand slots for each of the default shards.
TABLE_SIZE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _drawn(name: str, salt: str, below: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big") % below


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and stride of a shard's permutation; as size is prime, any stride from 1 visits every slot."""
    return _drawn(name, "offset", size), 1 + _drawn(name, "stride", size - 1)


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and no more than the slots")
    owner, free = [-1] * size, size
    prefers = [preference(s, size) for s in shards]
    at = [offset for offset, _ in prefers]
    while free:
        for shard, (_, stride) in enumerate(prefers):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + stride) % size
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a text key: the first 60 bits of its MD5, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size))


def place(docs: DataFrame, key: Column, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """The rows with two more columns, slot (long) and shard (int, its index in shards).

    key is a text column. Equal keys share a shard; a null key is the empty
    one. Columns that already have the new names are replaced. No row moves:
    the table of fixed size is broadcast. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, size))), f"`__slot` long, `{shard_name}` int")
    rows = docs.drop(shard_name).withColumn(slot_name, slot_of(F.coalesce(key, F.lit("")), size))
    return rows.join(F.broadcast(table), rows[slot_name] == table["__slot"]).drop("__slot")


def place_documents(docs: DataFrame, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Documents placed by doc_id; a document without one is placed by its text, so that such rows spread."""
    return place(docs, F.coalesce(F.col("doc_id").cast("string"), F.col("text")), shards, size)
