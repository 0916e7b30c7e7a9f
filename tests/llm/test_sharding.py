import hashlib

import pytest
from pyspark.sql import functions as F

from slopewise.llm import sharding


def test_turns_fill_the_table_like_a_plain_walk():
    names, size = ("a", "b", "c", "d", "e"), 101
    walks = []
    for n in names:
        offset, stride = sharding.preference(n, size)
        walks.append([(offset + k * stride) % size for k in range(size)])
    assert all(sorted(w) == list(range(size)) for w in walks)
    owner, turn = {}, 0
    while len(owner) < size:
        owner[next(s for s in walks[turn % 5] if s not in owner)] = turn % 5
        turn += 1
    assert sharding.lookup_table(names, size) == [owner[s] for s in range(size)]


def test_shares_are_even_and_a_lost_shard_moves_little():
    full = sharding.lookup_table()
    counts = [full.count(i) for i in range(len(sharding.SHARDS))]
    assert max(counts) - min(counts) <= 1
    less = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.05 * len(full)


def test_bad_parameters():
    for shards, size in ((("a",), 100), ((), 101), (("a", "a"), 101)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, size)


def test_placement(spark):
    rows = [(1, "x", 5), (1, "x", 6), (None, "t", 7), (None, "t", 8), (None, None, 9), (-4, "", 1), (2, "z" * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.place_documents(df).collect()
    table = sharding.lookup_table()
    assert len(got) == len(rows)
    for r in got:
        key = str(r.doc_id) if r.doc_id is not None else r.text or ""
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.place(df.limit(0), F.col("text")).collect() == []
