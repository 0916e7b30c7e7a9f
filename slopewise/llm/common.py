"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six blanks that separate words, for use inside a character class.
BLANKS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows handed to Python at once; long texts keep a batch of this size small enough for a worker.
BATCH_ROWS = 500


#: Most rows of ids that are broadcast; their number is counted first, and more are joined by shuffling.
BROADCAST_ROWS = 500_000


def broadcast_if_small(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, which should come from a checkpoint or a table, marked for broadcast if they are few enough."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def few_smallest(hash_: Column, wanted: int, known: Column) -> Column:
    """True for about twice the wanted rows and some more, those with the smallest hashes, of so many known; for all where few are known.

    Put before an order by hash with a limit, it keeps what meets in one task
    from growing with the number of tasks before it.
    """
    share = F.least(F.lit(1.0), F.lit(2.0 * wanted + 100) / F.greatest(known, F.lit(1)))
    return hash_.cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers receive, since single texts can be very long.

    Arrow's batches are a setting of the session and read when a plan is made,
    so it stays; a smaller bound that the user has set is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are taken apart into words at once.
PIECE_BYTES = 1 << 22


def pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A long text in pieces of about the size, cut at blanks, so that no word is cut."""
    at = 0
    while at < len(data):
        blank = _BLANK.search(data, at + size) if at + size < len(data) else None
        end = blank.start() if blank else len(data)
        yield data[at:end]
        at = end


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def as_bytes(text: Column) -> Column:
    """The text in UTF-8; Python then gets it without decoding."""
    return text.cast("binary")


def id_and_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """For two-column batches: the first column as it is, the second as a list of bytes."""
    for batch in batches:
        yield batch.column(0), batch.column(1).to_pylist()


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, total: str, position: str) -> DataFrame:
    """Adds the sum of value over the earlier rows of the group and the number of those rows.

    bucket must rise with order inside a group. The sums of whole buckets are
    added up first, so no task needs more than one bucket's rows of a group,
    however many rows the group has.
    """
    from pyspark.sql import Window as W

    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(c).alias(f"__{c}") for c in (*group, bucket)],
        F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
    )
    inside = W.partitionBy(*group, bucket).orderBy(*order)
    rows = df.withColumn("__in", F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col(value)).withColumn("__at", F.row_number().over(inside) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*group, bucket)]
    on = same[0]
    for cond in same[1:]:
        on = on & cond
    joined = rows.join(starts, on)
    return joined.select(*df.columns, (F.col("__s0") + F.col("__in")).alias(total), (F.col("__n0") + F.col("__at")).alias(position))
