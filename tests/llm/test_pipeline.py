import random

import corpus_pipeline
from pyspark.sql import functions as F

from slopewise.llm import mixing, quality, sharding
from slopewise.session import table
from tests.llm import brute
from tests.llm.test_mixing import plain_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path):
    """Documents with copies, benchmark passages, junk and odd rows, and the tables that go with them."""
    rng = random.Random(8)
    good = table(spark, "/root/testdata/sf0.01", "documents").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").limit(260).collect()
    item = "which of the following seven statements about the rivers and lakes of the north is true and why would that be so"
    rows = [(r.doc_id, r.text) for r in good]
    rows += [(5000 + i, rng.choice(good).text) for i in range(15)]
    lines = [x for r in good if r.quality for x in r.text.split("\n") if len(x) > 60]
    rows += [(6000 + i, "\n".join([*rng.sample(lines, 6), item, *rng.sample(lines, 3)])) for i in range(8)]
    rows += [(7000, None), (7001, ""), (None, "a text without an id but with words"), (5000, rows[260][1])]
    docs = [(i, t, "en", rng.choice(["a", "a", "b", None, "c"]), len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r.doc_id, r.quality, 0) for r in good], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return item


def test_each_stage_does_what_a_plain_version_does(spark, tmp_path):
    sf = f"file://{tmp_path}/sf"
    item = write(spark, sf)
    read = table(spark, sf, "documents")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in read.collect()]
        stage(spark, read, sf).write.parquet(f"{tmp_path}/{number}")
        after = spark.read.parquet(f"{tmp_path}/{number}")
        rows = [tuple(r)[:5] for r in after.collect()]
        key = lambda r: tuple(map(str, r))
        if number < 4:
            assert after.dtypes == read.dtypes
        if number == 0:
            learn = ~quality.held_out(F.col("doc_id"))
            model = quality.fit(read.where(learn), table(spark, sf, "labels").where(learn))
            expect = [r for r in before if model.score((r[1] or "").encode()) >= 0.3]
            assert 0 < len(expect) < len(before)
        elif number == 1:
            known = [r for r in before if r[0] is not None]
            prints = {r[0]: brute.fingerprint(r[1]) for r in known}
            group = brute.groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
            first = {r[0]: r for r in sorted(known, key=lambda r: str(r[1]), reverse=True)}
            expect = [r for r in before if r[0] is None] + [r for i, r in first.items() if group[i] == i]
            assert len(expect) < len(before)
            # Rows that agree in id and text differ in their source at most.
            key = lambda r: (str(r[0]), str(r[1]))
        elif number == 2:
            expect = [r for r in before if item not in (r[1] or "")]
            assert len(expect) < len(before)
        elif number == 3:
            plain = plain_mix([(r[0], r[1], r[3]) for r in before])
            expect = [r for r, (_, _, _, each, _) in zip(before, plain, strict=True) for _ in each]
            assert len(expect) > len(before)
        else:
            expect, owner = before, sharding.lookup_table()
            assert all(r.shard == owner[r.slot] for r in after.collect())
        assert sorted(map(key, rows)) == sorted(map(key, expect)), corpus_pipeline.STAGES[number][0]
        read = after


def test_run_gives_the_rows_of_its_stages_and_stands_empty_tables(spark, tmp_path):
    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.collect() == [] and out.columns[-2:] == ["slot", "shard"]


def test_mixed_documents_with_repeated_rows(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b d", "x", 1), (1, "a b c", "x", 1), (2, "e", "y", 1), (3, None, "y", 1), (3, "", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = [tuple(r) for r in mixing.mixed_documents(df).collect()]
    took = mixing.mix(df).collect()
    assert len(got) == sum(-(-r.taken // r.size) for r in took if r.size)
    assert set(got) <= set(rows)
