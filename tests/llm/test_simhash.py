import random

import numpy as np
from pyspark.sql import functions as F

from slopewise.llm import simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, component_id int, fp string"


def run(spark, rows):
    out = simhash.near_duplicates(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA))
    return [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in out.collect()]


def test_documents_match_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "Été", "ABC"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 60, 300]))) for _ in range(60)]
    for t in texts[:25]:
        w = t.split()
        if len(w) > 50:
            w[rng.randrange(len(w))] = "other"
            texts.append("\t\n ".join(w))
    texts += ["", "  \x0b", "x" * 5000, None, texts[3], texts[3]]
    rows = list(enumerate(texts))
    prints = {i: brute.fingerprint(t) for i, t in rows}
    expect = brute.groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert sorted(run(spark, rows)) == sorted((i, prints[i], expect[i]) for i in prints)


def test_rows_without_id_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "completely different words are here"), (9, "completely different words are here"), (4, "alone"), (4, "alone")]
    got = run(spark, rows)
    assert sorted((i, c) for i, _, c in got if i is not None) == [(4, 4), (4, 4), (7, 7), (7, 7), (9, 7)]
    assert [c for i, _, c in got if i is None] == [None]
    assert run(spark, []) == []


def test_every_link_shares_a_ring_key():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        a = int(rng.integers(0, 2**64, dtype=np.uint64))
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(bit)
        found = False
        for start in range(8):
            turn = lambda x: ((x >> 8 * start) | (x << (64 - 8 * start))) & (2**64 - 1)
            x, y = turn(a), turn(b)
            same = (x & 0xFFFF) == (y & 0xFFFF) and ((x >> 16 & 0xFFF) == (y >> 16 & 0xFFF) or (x >> 28 & 0xFFF) == (y >> 28 & 0xFFF))
            found |= same and bool(simhash._linked(np.array([a ^ b], np.uint64), 8 * start)[0])
        assert found


def test_large_groups_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    prints = {0}
    while len(prints) < 260:  # a dense cloud: walks of one or two bits in the upper half
        base = rng.choice(sorted(prints))
        prints.add(base ^ (1 << rng.randrange(40, 63)) ^ rng.choice([0, 1 << rng.randrange(20, 60)]))
    nodes = {fp: i for i, fp in enumerate(sorted(prints))}
    df = spark.createDataFrame([(fp, i) for fp, i in nodes.items()], "fp long, node long")
    links = {(r.a, r.b) for r in simhash.link_fingerprints(df).collect()}
    of = {i: fp for fp, i in nodes.items()}
    assert all((of[a] ^ of[b]).bit_count() <= 3 for a, b in links)
    assert brute.groups(of, lambda a, b: (a, b) in links or (b, a) in links) == brute.groups(of, lambda a, b: (of[a] ^ of[b]).bit_count() <= 3)


def test_hex_digits(spark):
    got = spark.createDataFrame([(0,), (-1,), (255,)], "fp long").select(simhash.hex_digits(F.col("fp")).alias("h")).collect()
    assert [r.h for r in got] == ["0" * 16, "f" * 16, "0" * 14 + "ff"]


def test_the_stage_of_the_pipeline_links_fingerprints_and_similar_sets(spark):
    """1 and 2 share a fingerprint but few shingles; 2 and 3, 4 and 5 have similar sets; 6 is alone."""
    import corpus_pipeline
    from slopewise.llm import jaccard

    often = "one two three four five " * 200
    words = lambda at, n: " ".join(f"w{at + k}" for k in range(n))
    texts = [often + words(0, 12), often + words(100, 40), often + words(100, 41), words(500, 60), words(500, 61), words(900, 60)]
    docs = spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bits = [simhash.simhash(t.encode()) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= 3 < (bits[3] ^ bits[4]).bit_count()
    only = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert only[1] != only[2] == only[3]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 6]
