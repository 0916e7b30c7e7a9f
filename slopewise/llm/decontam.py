"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, units after numbers and names inside sentences become typed
placeholders; the rest is lower-cased words. Windows of WIDTH such tokens are
hashed and joined with the benchmark's windows, so a question matches again
after its numbers and names were exchanged. Windows are also joined by their
words and values as they are, whatever is a placeholder, so a copy word for
word matches however short or rich in names and numbers it is.

Matches that lie on one diagonal (document position minus item position) must
also exchange consistently. A window counts if its names and numbers are those
of the item. Else each of its names must stand for what most mentions of the
item's name on the diagonal stand for, and equal numbers inside the window must
stay equal; a window that conflicts is dropped alone. Different values may
become equal, and units may change one by one.

A text is cut into tokens once, for both kinds of windows and all their widths.
Items that agree in their template, or in all their words, are one form; the
windows are joined with the forms, and the items come in after the matches of a
document and a form have become one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewise.llm.common import broadcast_if_small
from slopewise.session import cut

#: Tokens of a window, those of them that must be literal, and the shortest item that is searched for.
WIDTH, LITERAL, SHORTEST = 8, 4, 5
#: Share of an item's tokens that matching windows must cover.
COVERAGE = 0.3
#: Most benchmark windows, and bytes of the benchmark's items, that are broadcast; larger tables are joined by shuffling.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 1 << 25

#: Private-use characters that no canonical text holds otherwise.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = (
    "kg|g|mg|lb|lbs|oz|ton|tons|tonnes|km|m|cm|mm|mi|ft|inch|inches|mile|miles|meter|meters|metre|metres|yard|yards|foot|feet|"
    "l|ml|liter|liters|litre|litres|gallon|gallons|s|sec|second|seconds|min|minute|minutes|h|hr|hour|hours|day|days|week|weeks|"
    "month|months|year|years|dollar|dollars|cent|cents|euro|euros|pound|pounds|percent|mph|kmh|degrees|watts|volts"
)


def _tokens(text: Column) -> Column:
    """Canonical tokens; a placeholder is a mark followed by what it stands for."""
    t = F.regexp_replace(text, r"(?<=\p{N})[.,:](?=\p{N})", "")
    t = F.regexp_replace(t, r"(?<=[\p{Ll},;:] )(\p{Lu}\p{Ll}\p{L}*)", f" {NAME}$1 ")
    t = F.regexp_replace(t, rf"(\p{{N}}) ?(?i:({UNITS})\b|[%$€£])", f"$1 {UNIT}$2 ")
    t = F.regexp_replace(t, r"\p{N}+", f" {NUMBER}$0 ")
    words = F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}{NAME}-{UNIT}]+", -1)
    return F.filter(words, lambda w: w != "")


def _is_slot(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(NAME, NUMBER, UNIT)


def _forms(rows: DataFrame) -> DataFrame:
    """Adds template, hashes of the tokens with placeholders for what they stand for, slots, where these are, and plain, hashes of the words and values as they are.

    What stands before a word can make it a name or not, so the marks of
    placeholders are left out of the latter. It is null where it equals the
    template, as there are no slots.
    """
    bare = lambda t: F.when(_is_slot(t), F.substring(t, 1, 1)).otherwise(t)
    rows = rows.withColumn("template", F.transform("tokens", lambda t: F.xxhash64(bare(t)))).withColumn("slots", F.filter(F.transform("tokens", lambda t, i: F.when(_is_slot(t), i)), lambda i: i.isNotNull()))
    return rows.withColumn("plain", F.when(F.size("slots") > 0, F.transform("tokens", lambda t: F.xxhash64(F.translate(t, NAME + NUMBER + UNIT, "")))))


def _window(marks: Column, width: int) -> Callable[[Column], Column]:
    return lambda i: F.struct(F.lit(width).alias("width"), i.alias("pos"), F.xxhash64(F.slice(marks, i + 1, width)).alias("h"))


def _windows(widths: list[int]) -> Column:
    """Structs (width, pos, h) for the windows of a row's forms: each of the template, and of the words as they are those with a slot, as others are the same."""
    every = []
    for width in widths:
        last = F.size("template") - width
        around = F.array_distinct(_around(last, width))
        every.append(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), _window(F.col("template"), width))))
        every.append(F.when((last >= 0) & (F.size("slots") > 0), F.transform(around, _window(F.col("plain"), width))))
    return F.flatten(F.filter(F.array(*every), lambda x: x.isNotNull()))


def _around(last: Column, width: int) -> Column:
    """Starts of the windows that hold a slot."""
    return F.flatten(F.transform("slots", lambda p: F.sequence(F.least(F.greatest(p - (width - 1), F.lit(0)), last), F.least(p, last))))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, n_tokens, n_covered, coverage, n_slots), one row for each document and item that it holds.

    An item is held if windows that count cover at least the given share of its
    tokens. Items shorter than the window are searched as one window; null
    texts and items without words take no part. Windows with fewer than LITERAL
    literal tokens, and those of items of fewer than SHORTEST tokens, count only
    word for word, as runs of placeholders match anything. Rows that repeat a
    document or an item give one row; documents that share an id but not the
    text (xxhash64 tells) are apart, and a null id is an id of its own. Long
    texts are searched whole. Empty tables give no rows.
    """
    items = benchmark.select("item_id", F.col("text").alias("item_text")).where(F.col("item_text").isNotNull()).distinct()
    items = _forms(items.withColumn("tokens", _tokens(F.col("item_text")))).withColumn("n_tokens", F.size("tokens")).where("n_tokens > 0").withColumn("width", F.least("n_tokens", F.lit(width)))
    items = cut(items.withColumn("item_key", F.xxhash64("item_id", "item_text")).withColumn("n_slots", F.size(F.filter("tokens", _is_slot))))
    present = sorted(r["width"] for r in items.select("width").distinct().collect()) or [width]  # at most WIDTH values
    bounds = items.agg(F.sum(F.octet_length("item_text")).alias("bytes")).first()["bytes"] or 0
    # Windows of each form: all of the words as they are, and the template's where they have slots and are literal enough.
    last, every = F.col("n_tokens") - F.col("width"), F.coalesce("plain", "template")
    literal = F.size(F.filter(F.slice("tokens", F.col("bpos") + 1, F.col("width")), lambda t: ~_is_slot(t)))
    rich = (F.col("n_tokens") >= SHORTEST) & (literal < F.col("width")) & (literal >= F.least(F.lit(LITERAL), F.col("width")))
    post = lambda marks, verbatim: F.struct(F.lit(verbatim).alias("verbatim"), F.xxhash64(F.lit(verbatim), marks).alias("form"), F.xxhash64(F.slice(marks, F.col("bpos") + 1, F.col("width"))).alias("h"))
    posts = items.withColumn("bpos", F.explode(F.sequence(F.lit(0), last)))
    posts = posts.withColumn("w", F.explode(F.filter(F.array(post(every, True), F.when(rich, post(F.col("template"), False))), lambda w: w.isNotNull())))
    posts = cut(posts.select("item_key", "w.form", "w.h", "w.verbatim", "width", "bpos"))
    of_form = posts.select("form", "item_key").distinct()
    posts = posts.drop("item_key").distinct().withColumnRenamed("width", "n")
    posts = F.broadcast(posts) if posts.count() <= BROADCAST_WINDOWS else posts
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    seen = _forms(rows.withColumn("tokens", _tokens(F.col("text")))).select("doc_id", "text_hash", F.explode(_windows(present)).alias("w")).select("doc_id", "text_hash", "w.*")
    hits = seen.join(posts, (seen["h"] == posts["h"]) & (F.col("width") == F.col("n")))
    hits = hits.select("doc_id", "text_hash", "form", "bpos", F.when(~F.col("verbatim"), F.col("pos")).alias("pos"))
    # Of windows that match as they are, the item's position is enough: all of them count.
    met = hits.groupBy("doc_id", "text_hash", "form").agg(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "bpos"))).alias("hits"), F.collect_set(F.when(F.col("pos").isNull(), F.col("bpos"))).alias("verbatim"))
    small = bounds <= BROADCAST_BYTES
    met = met.join(F.broadcast(of_form) if small else of_form, "form").groupBy("doc_id", "text_hash", "item_key").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("verbatim")).alias("verbatim"))
    named = items.select("item_key", "item_id", F.col("tokens").alias("marked"), "n_tokens", "width", "n_slots")
    pairs = met.join(F.broadcast(named) if small else named, "item_key").withColumn("n_all", _covered(F.concat(F.transform("hits", lambda x: x["bpos"]), "verbatim")))
    pairs = cut(pairs.where(F.col("n_all") >= coverage * F.col("n_tokens")))
    plain = pairs.where("n_slots = 0").select("doc_id", "text_hash", "item_id", "n_tokens", F.col("n_all").alias("n_covered"), "n_slots")
    slotted = pairs.where("n_slots > 0")
    found = plain if slotted.isEmpty() else plain.unionByName(_consistent(slotted, rows, coverage))
    best = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct(F.col("n_covered") / F.col("n_tokens"), "n_covered", "n_tokens", "n_slots")).alias("x"))
    return best.select("doc_id", "text_hash", "item_id", F.col("x.n_tokens").cast("long").alias("n_tokens"), F.col("x.n_covered").cast("long").alias("n_covered"), F.col("x.col1").alias("coverage"), F.col("x.n_slots").cast("long").alias("n_slots"))


def _covered(positions: Column) -> Column:
    """Item tokens under windows that begin at these positions; the row gives the width."""
    return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda b: F.sequence(b, b + F.col("width") - 1)))))


def _with_texts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs with own, the document's tokens and what they stand for; of the texts only those of the pairs are cut again."""
    wanted = broadcast_if_small(pairs.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct())
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).dropDuplicates(["d", "t"]).select("d", "t", _tokens(F.col("text")).alias("own"))
    return pairs.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).drop("d", "t")


def _consistent(pairs: DataFrame, rows: DataFrame, coverage: float) -> DataFrame:
    """The pairs whose consistent windows cover enough, as rows like those without slots."""
    key = ["doc_id", "text_hash", "item_id", "item_key", "n_tokens", "width", "n_slots"]
    both = _with_texts(pairs.where(F.size("hits") > 0), rows)
    met = F.transform("hits", lambda x: F.struct((x["pos"] - x["bpos"]).alias("diagonal"), x["bpos"].alias("bpos"), F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.struct((x["bpos"] + k).alias("at"), F.get("marked", x["bpos"] + k).alias("theirs"), F.get("own", x["pos"] + k).alias("ours"))).alias("spots")))
    lines = both.select(*key, F.explode(met).alias("m")).select(*key, "m.*").groupBy(*key, "diagonal").agg(F.collect_set(F.struct("bpos", "spots")).alias("windows"))
    of = lambda spots, kind: F.filter(spots, lambda s: F.substring(s["theirs"], 1, 1) == kind)
    lines = lines.withColumn("votes", F.array_distinct(F.flatten(F.transform("windows", lambda w: of(w["spots"], NAME)))))
    # A name that no value stands for in more than half of its places conflicts wherever it is exchanged.
    most = lambda s: 2 * F.size(F.filter("votes", lambda v: (v["theirs"] == s["theirs"]) & (v["ours"] == s["ours"]))) > F.size(F.filter("votes", lambda v: v["theirs"] == s["theirs"]))
    equal = lambda numbers: F.size(F.array_distinct(F.transform(numbers, lambda s: s["theirs"]))) == F.size(F.array_distinct(F.transform(numbers, lambda s: F.struct(s["theirs"].alias("a"), s["ours"].alias("b")))))
    same = lambda spots: F.forall(spots, lambda s: (s["theirs"] == s["ours"]) | (F.substring(s["theirs"], 1, 1) == UNIT))
    fair = F.filter("windows", lambda w: same(w["spots"]) | (F.forall(of(w["spots"], NAME), most) & equal(of(w["spots"], NUMBER))))
    starts = lines.select(*key, F.transform(fair, lambda w: w["bpos"]).alias("starts"))
    starts = starts.unionByName(pairs.select(*key, F.col("verbatim").alias("starts"))).groupBy(*key).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return starts.withColumn("n_covered", _covered(F.col("starts"))).where(F.col("n_covered") >= coverage * F.col("n_tokens")).select("doc_id", "text_hash", "item_id", "n_tokens", "n_covered", "n_slots")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, as they came, that hold no item. Null texts stay."""
    bad = broadcast_if_small(cut(contaminated(docs, benchmark, **options).select("doc_id", "text_hash").distinct()))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"]), "left_anti")
