"""The registered queries against their SQL on the smallest tables and on one with odd rows."""

import os

import duckdb
import pytest

from slopewise.llm import queries
from tests.test_queries import SF, TABLES, tidy


def compare(spark, folder, name, con):
    got = queries.QUERIES[name](spark, folder).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    compare(spark, SF, name, con)


def test_decontamination_sql_with_names_numbers_and_units(spark, tmp_path):
    from tests.llm.test_decontam import ITEM, MIXED, OTHER, PLAIN

    texts = [(1, ITEM), (2, "it is known. " + OTHER + " so it is"), (3, MIXED), (4, None), (5, PLAIN.upper()), (None, PLAIN), (6, "so Bo Ci Du Ev met 1.2.3,4 km on 5kg, 7% and 12:30h"), (7, OTHER.replace("Peter Miller buys", "Robert Miller buys")),
             (8, "they asked who wrote Hamlet yesterday"), (9, "is Mount Kenya higher than Mount Kilimanjaro or not"), (10, ITEM.replace("Jonas", "Peter", 1)), (11, ITEM + " and " + OTHER)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, ITEM), (2, PLAIN), (2, PLAIN), (3, None), (4, "so Bo Ci Du Ev met 9.8 km on 6kg, 3% and 11:15h"), (5, "who wrote this famous book"), (6, "Who wrote Hamlet?"), (7, "Is Mount Kenya higher than Mount Kilimanjaro"), (8, "...")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "op2_template_decontamination"
    assert {(d, i) for d, i, *_ in con.execute(queries.ORACLE_SQL[name]).fetchall()} >= {(1, 1), (2, 1), (5, 2), (None, 2), (8, 6), (9, 7), (10, 1), (11, 1)}
    compare(spark, str(tmp_path), name, con)


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_sql_hash_is_xxh64():
    import random

    import xxhash

    from slopewise.llm.xxh64_sql import xxh64_tables

    rng = random.Random(1)
    texts = ["", "é" * 5] + ["".join(rng.choice("abc ñ1") for _ in range(n)) for n in range(1, 100)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in texts])
    for seed in (0, 42):
        got = con.execute(f"WITH {xxh64_tables('t', seed)} SELECT s, h FROM hashed").fetchall()
        assert len(got) == len(texts) and all(h == xxhash.xxh64_intdigest(s.encode(), seed) for s, h in got)
