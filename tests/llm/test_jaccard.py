import random

import corpus_pipeline

from slopewise.llm import jaccard
from slopewise.operators import components
from tests.llm import brute


def grams(text, width=5):
    words = brute.WORD.findall(brute.lower(text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def near(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def edited_copies(rng):
    """Originals, then copies of some with words exchanged throughout, about the limit and well within it."""
    words = [f"w{i}" for i in range(400)] + ["Ärger", "ABC"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 4, 5, 60, 200, 400]))) for _ in range(60)]
    for t in texts[:40]:
        for share in (0.005, 0.01, 0.02, 0.03):
            w = t.split()
            for k in rng.sample(range(len(w)), round(share * len(w))):
                w[k] = "other"
            texts.append("\t\n ".join(w))
    return [*texts, "", None, "  \x0b", texts[0], "x" * 5000]


def test_edited_copies_match_brute_force(spark):
    rows = list(enumerate(edited_copies(random.Random(1))))
    sets = {i: grams(t) for i, t in rows}
    expect = brute.groups(sets, lambda a, b: near(sets[a], sets[b]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect()) == sorted(expect.items())
    # Three bits of a fingerprint would leave some of them apart.
    prints = {i: brute.fingerprint(t) for i, t in rows}
    assert len(set(brute.groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3).values())) > len(set(expect.values()))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expect.values()))


def test_groups_in_blocks_rows_without_id_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        w = list(base)
        w[rng.randrange(100)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(w))
    rows = [*enumerate(texts), (100, "quite another text of six words"), (101, "quite another text of six words"), (101, texts[0] + " end"), (None, texts[0])]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 0) for i in range(60)} | {(100, 0), (101, 0), (None, None)}
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_few_links_need_no_rounds(spark, monkeypatch):
    """Each round's exchanges took threads and memory of the driver; many links still go by rounds, to the same groups."""
    rows = list(enumerate(edited_copies(random.Random(3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rounds, check = [], components._unfinished
    monkeypatch.setattr(components, "_unfinished", lambda edges: rounds.append(1) or check(edges))
    few = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert not rounds and len(few) < len(rows)
    monkeypatch.setattr(components, "MOST_LINKS", 0)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == few
    assert rounds
