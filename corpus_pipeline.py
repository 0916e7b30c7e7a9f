"""A corpus pipeline of five stages, each an operator of slopewise.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written
as Parquet and read again as the documents of the next stage, which cuts the
lineage. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.llm import decontam, jaccard, mixing, quality, sharding, simhash
from slopewise.session import fresh_path, table

#: Not SQL: the first two stages learn a model and link near-duplicates. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of documents outside the held-out part, rejects go."""
    learn = ~quality.held_out(F.col("doc_id"))
    model = quality.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates stays; rows without an id stay.

    Links are pairs of SimHash fingerprints at three or fewer differing bits,
    searched by pigeonring chains. Three bits of 64 are strict, so pairs with a
    Jaccard similarity of at least 0.8 of their five-word shingles are linked
    besides. Rows that repeat a kept doc_id give one row, that with the
    smallest text.
    """
    return simhash.one_of_each_group(docs, groups=simhash.joined(simhash.near_duplicates(docs), jaccard.near_duplicates(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, with whatever numbers, units and names, go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it: not at all, once or twice, in the order of its places in the schedule; one that is taken in part appears whole."""
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard."""
    return sharding.place_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_low_quality),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), fresh_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
