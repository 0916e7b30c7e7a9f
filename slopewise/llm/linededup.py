"""Line deduplication across documents, in DataFrame operations only.

Lines are exploded with their positions and reduced to hashes of their keys.
Documents are counted for each hash in two steps, (key, document) and then key,
so a line that stands in every document never meets in one task. What comes
back to the text is the list of its dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewise.llm.common import lower_ascii
from slopewise.session import cut

BLANK_CHARS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK_CHARS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped), one row a document, kept being the text without its dropped lines.

    A key of at least min_chars code points that at least min_docs documents
    hold keeps its lines only in the largest doc_id holding it. Keys are told
    apart by 128 bits of hash. A null or empty text is one empty line; a text
    of which all lines go becomes the empty string. Rows that share a doc_id
    count as one document, and rows with a null doc_id as one that sorts below
    all others. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    # Only long lines are exploded; a line shorter than min_chars cannot have a key that long.
    entries = F.filter(
        F.transform(_lines(F.col("text")), lambda line, at: F.struct(at.alias("at"), _key(line).alias("key"))),
        lambda e: F.char_length(e["key"]) >= min_chars,
    )
    exploded = rows.where(F.char_length("text") >= min_chars).select("doc_id", "text_hash", F.explode(entries).alias("e"))
    hashed = exploded.select(
        "doc_id",
        F.xxhash64("e.key").alias("h1"),
        F.xxhash64(F.lit(1), F.col("e.key")).alias("h2"),
        "text_hash",
        F.col("e.at").alias("at"),
    )
    # Positions of a key in one text; rows that share an id, or have none, stay apart by their texts, and equal rows are one.
    held = cut(hashed.groupBy("h1", "h2", "doc_id", "text_hash").agg(F.collect_set("at").alias("positions")))  # the texts are split once
    documents = held.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    common = documents.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    common = common.select(F.bitwise_not("h1").alias("k1"), "h2", "keeper")
    # The complemented key makes the join deal both sides anew, so that adaptive execution can split a frequent line.
    losing = held.withColumn("k1", F.bitwise_not("h1")).join(common, ["k1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    dropped = losing.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))
    joined = rows.join(dropped, rows["doc_id"].eqNullSafe(dropped["d"]) & (rows["text_hash"] == dropped["h"]), "left")
    # The lines are a column of their own, used several times: else the text would be split anew for every line.
    joined = joined.withColumn("lines", _lines(F.col("text")))
    lines = F.col("lines")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("positions"))
    kept = F.when(F.col("positions").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(places, lambda at: F.get(lines, at)), "\n"))
    return joined.select(
        "doc_id",
        kept.alias("kept"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("positions").isNull(), 0).otherwise(F.size("positions")).cast("long").alias("n_dropped"),
    )
