"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of places, each filled by one block of words; all blocks are
equally long. The source of a place is found by mapping the van der Corput
point of its number through the cumulative targets of the sources, so any
stretch of the mix holds the sources in about their shares. A source's places,
ranked, take the blocks of its own stream in turn: its documents, shuffled by a
hash, laid end to end. A stream that is used up starts again, at most once.
What a document takes part in the mix with is what its words lend to blocks
that have a place, and its own places are those of these blocks.

There are 2**k places, so a source gets the number of grid points in its share
of the unit interval, and its words differ from its target by less than a block.

A hot source never meets in one task: running sums go over hash ranges first,
slots are ranked the same way over stretches of the schedule, and equal rows
are laid as one run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopewise.llm.common import BLANKS, running
from slopewise.session import cut

#: Weights by place in the code point order of the sources, repeating.
WEIGHTS = (3, 1, 2)
#: Words of all targets together for each word there is, and the most uses of a source.
TOTAL, MOST = 1.5, 2.0
#: Longest block, and 2**k places that there are at least, where the mix has as many words.
BLOCK_WORDS, LEAST_BITS = 65536, 18
#: The unit interval is cut into 2**k cells to find the source of a point; as many places make a stretch.
CELL_BITS = 12
#: Equal rows that are laid and told apart in one task.
RUN = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def place_bits(words: int, block_words: int = BLOCK_WORDS, least_bits: int = LEAST_BITS) -> int:
    """The places of a mix of so many words are 2 to this power: blocks of at most block_words words and at least one."""
    return min(max(words, 1).bit_length() - 1, max(least_bits, math.ceil(math.log2(max(words, 1) / block_words))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Adds target to the one-row-a-source table (source, source_size).

    Shares follow the weights until a source reaches most times its size; the
    excess goes to the others by weight until none is above. The level at which
    that settles is found in one pass over the sources in the order in which
    they fill up, so the window below has one row a source.
    """
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    rows = rows.withColumn("limit", F.col("source_size") * most).withColumn("fills", F.col("limit") / F.col("w"))
    filled = W.orderBy("fills", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("rest", F.sum("source_size").over(everything) * total - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("rest") / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # The first source that does not fill up sets the level for itself and all later ones.
    level = F.min(F.when(F.col("fills") > F.col("level"), F.struct("fills", F.col("source").isNull().alias("last"), "source", "level"))).over(everything)["level"]
    rows = rows.withColumn("final", level)
    return rows.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("fills") <= F.col("final")), F.col("limit")).otherwise(F.col("final") * F.col("w")).alias("target"))


def schedule(plan: DataFrame, bits: int) -> DataFrame:
    """(place, source_no, turn): the source of each of the 2**bits places of the mix, turn being the place's rank among its source's.

    plan is (source_no, target) with one row a source. Targets count as whole
    words; a source whose share of the unit interval holds no point has no
    place. Without any words there are no places.
    """
    places, cell_bits = 1 << bits, min(bits, CELL_BITS)
    upto = W.orderBy("source_no")
    everything = upto.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    goal = F.round("target").cast("long")
    ends = plan.select("source_no", F.sum(goal).over(upto).alias("hi"), F.sum(goal).over(everything).alias("all"), goal.alias("goal")).where("goal > 0")
    shares = ends.select("source_no", ((F.col("hi") - F.col("goal")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"))
    last = (1 << cell_bits) - 1
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * (last + 1)), F.least(F.floor(F.col("hi") * (last + 1)), F.lit(last)))))
    # The van der Corput point of a place: its binary digits in reverse, behind the point.
    mirrored = F.conv(F.reverse(F.lpad(F.bin("id"), max(bits, 1), "0")), 2, 10).cast("long")
    walk = plan.sparkSession.range(places).select(F.col("id").alias("place"), mirrored.alias("grid"))
    walk = walk.select("place", F.expr(f"shiftright(grid, {bits - cell_bits})").alias("cell"), (F.col("grid") / F.lit(float(places))).alias("u"))
    hit = walk.join(F.broadcast(cells), "cell").where("u >= lo and u < hi").select("place", "source_no", F.expr(f"shiftright(place, {CELL_BITS})").alias("stretch"), F.lit(1).alias("one"))
    return running(hit, ["source_no"], "stretch", ["place"], "one", "turn", "again").select("place", "source_no", F.col("turn").cast("long").alias("turn"))


def _key(doc_id: Column, text: Column) -> Column:
    """What documents are shuffled by; rows with an equal key have the same id and text."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def _laid(docs: DataFrame, id_col: str, text_col: str, source_col: str, block_words: int, least_bits: int, weights: tuple[float, ...], total: float, most: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The runs of equal rows, the plan of the sources, and the passes of the documents with words.

    runs is (source, key, doc_id, size, n), the plan (source, source_no,
    source_size, target). passes is (key, doc_id, source_no, size, n, no, pass,
    words, place, places): one row for each time that a document's words come
    up, with the words in blocks that have a place, the first of these places
    and their number. no tells rows with equal keys apart.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _key(F.col(id_col), F.col(text_col)).alias("key"))
    runs = cut(rows.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")))  # narrow rows; the texts are read once
    sizes = runs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("known"))
    numbered = targets(sizes.select("source", "source_size"), weights, total, most).withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    plan = cut(numbered)
    most_known, words = sizes.agg(F.max("known")).first()[0] or 0, plan.agg(F.sum(F.round("target").cast("long"))).first()[0] or 0
    # About as many ranges of the key as rows in a range, so that neither sum of the two has many rows in one task.
    digits = 1
    while 16 ** (2 * digits) < most_known:
        digits += 1
    bits = place_bits(words, block_words, least_bits)
    block = max(words, 1) / (1 << bits)
    named = F.broadcast(plan.withColumnRenamed("source", "named"))
    laid = _parts(runs.where("size > 0")).join(named, F.col("source").eqNullSafe(F.col("named")))
    laid = laid.withColumn("span", F.col("size") * F.col("copies")).withColumn("range", F.substring("key", 1, digits)).drop("source", "named")
    laid = running(laid, ["source_no"], "range", ["key", "part"], "span", "start", "position")
    each = laid.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    each = each.withColumn("no", F.col("part") * RUN + F.col("copy")).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    # Words a to b of the stream, if it is used that often; block t holds its words from floor(t * block) on. No block behind the target has a place.
    passes = each.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("a", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("b", F.col("a") + F.col("size"))
    passes = passes.where((F.col("pass") == 0) | (F.col("a") < F.col("target") + 2 * block))
    begins = lambda t: F.floor(t * F.lit(block))
    turns = F.filter(F.sequence(F.greatest(F.floor(F.col("a") / block) - 1, F.lit(0)), F.floor(F.col("b") / block) + 1), lambda t: (begins(t) < F.col("b")) & (begins(t + 1) > F.col("a")))
    spans = passes.select("key", "doc_id", "source_no", "size", "n", "no", "pass", "a", "b", F.explode(turns).alias("turn"))
    spans = spans.withColumn("words", F.least("b", begins(F.col("turn") + 1)) - F.greatest("a", begins(F.col("turn"))))
    taken = spans.join(schedule(plan.select("source_no", "target"), bits), ["source_no", "turn"], "left")
    placed = F.col("place").isNotNull()
    return runs, plan, taken.groupBy("key", "doc_id", "source_no", "size", "n", "no", "pass").agg(
        F.sum(F.when(placed, F.col("words")).otherwise(0)).cast("long").alias("words"), F.min("place").alias("place"), F.count("place").alias("places")
    )


def _parts(runs: DataFrame) -> DataFrame:
    """Runs of equal rows in parts of at most RUN copies."""
    parts = runs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    return parts.withColumn("copies", F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("part") * RUN))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, least_bits: int = LEAST_BITS, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_place, places), one row a document.

    taken counts the words in blocks that have a place in the schedule, places
    is the number of these blocks and first_place the first of their places,
    null if there are none. Rows with a null source form a source of their own,
    last in order. A null text has size 0; documents without words have taken
    0. Documents are shuffled by a hash of id and text, so rows with a null id
    spread like others, and rows that agree in both are interchangeable. Empty
    tables give no rows.
    """
    runs, plan, passes = _laid(docs, id_col, text_col, source_col, block_words, least_bits, weights, total, most)
    named = F.broadcast(plan)
    taken = passes.groupBy("key", "doc_id", "source_no", "size", "no").agg(F.sum("words").alias("taken"), F.min("place").alias("first_place"), F.sum("places").alias("places"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "first_place", "places"]
    some = taken.join(named, "source_no").select(*columns)
    none = _parts(runs.where("size = 0")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).join(named.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
    nothing = F.lit(0).cast("long")
    return some.unionByName(none.select("doc_id", "source", "size", "source_size", "target", nothing.alias("taken"), F.lit(None).cast("long").alias("first_place"), nothing.alias("places")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, with the columns they came with, in the order of the mix, each as often as the mix takes it (0 to 2 times).

    A document stands where the first of its words has a place; one that is
    taken in part appears whole. The columns are doc_id, text and source among
    others. Written to files, the parts of the result in their order are the
    mix: each begins where the one before ends.
    """
    _, plan, passes = _laid(docs, "doc_id", "text", "source", options.pop("block_words", BLOCK_WORDS), options.pop("least_bits", LEAST_BITS), options.pop("weights", WEIGHTS), options.pop("total", TOTAL), options.pop("most", MOST))
    if options:
        raise TypeError(f"unknown options: {sorted(options)}")
    copies = cut(passes.where("words > 0").join(F.broadcast(plan.select("source_no", "source")), "source_no").select(F.col("key").alias("k"), F.col("source").alias("s"), "n", "no", "place"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _key(F.col("doc_id"), F.col("text")).alias("key"))
    same = (F.col("key") == F.col("k")) & F.col("doc.source").eqNullSafe(F.col("s"))
    found = rows.join(copies.where("n = 1"), same).select("doc", "key", "place")
    several = copies.where("n > 1")
    if not several.isEmpty():
        # Rows that repeat id, text and source are numbered; only these meet by their key.
        known = several.select("k", "s").distinct()
        number = F.row_number().over(W.partitionBy("k", "s").orderBy(F.xxhash64("doc"))) - 1
        numbered = rows.join(known, same).withColumn("number", number).drop("k", "s")
        found = found.unionByName(numbered.join(several, same & (F.col("number") == F.col("no"))).select("doc", "key", "place"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    highest = copies.agg(F.max("place")).first()[0] or 0
    home = F.floor(F.col("place") * parts / F.lit(highest + 1)).cast("int")
    return found.repartitionById(parts, home).sortWithinPartitions("place", "key").select("doc.*")
