"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of a bounded sample
of its texts. A text is lower-cased, cut into pieces, and every piece is
compressed with every dictionary; the language whose dictionary gives the
fewest bytes in all is the answer. The margin to the runner-up tells how far to
trust it: narrow margins are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopewise.llm.common import as_bytes, broadcast_if_small, few_smallest, id_and_bytes, pieces, small_batches
from slopewise.session import cut

#: Bounds of the sample for the dictionaries: documents of a language, bytes of its dictionary, and bytes of all dictionaries together.
SAMPLE_DOCS, DICTIONARY_BYTES, MODEL_BYTES = 2048, 262144, 1 << 26
#: Bytes of a snippet; a document's snippets lie evenly over its whole text.
SNIPPET = 128
#: Bytes that are compressed at once, and zstandard's level.
PIECE, LEVEL = 512, 3
#: Relative gain over the runner-up below which an answer counts as rejected.
MARGIN = 0.02
UNKNOWN = "und"

#: ASCII capitals become small letters and other ASCII characters a space; letters of other alphabets stay as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = regex.compile(rb"[A-Za-z]")


def fold(data: bytes) -> bytes:
    """All words of the text in their order, in small letters, with one space between them."""
    lowered = data if data.isascii() else data.decode("utf-8", "replace").lower().encode()
    return b" ".join(lowered.translate(_FOLD).split())


def has_letter(data: bytes) -> bool:
    return bool(_ASCII_LETTER.search(data)) or (not data.isascii() and bool(_LETTER.search(data.decode("utf-8", "replace"))))


def spread(data: bytes, wanted: int, snippet: int = SNIPPET) -> bytes:
    """About the wanted bytes of the folded text: all of it, or snippets that lie evenly from its beginning to its end."""
    folded = b" ".join(fold(piece) for piece in pieces(data))
    if len(folded) <= wanted:
        return folded
    count = max(1, wanted // snippet)
    size = min(snippet, wanted)
    last = len(folded) - size
    starts = [last // 2] if count == 1 else [last * i // (count - 1) for i in range(count)]
    return b" ".join(folded[at : at + size] for at in starts)


def learnable(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether a document may be learned from: its part of the hash is not held out. Rows without an id are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != part, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, model_bytes: int = MODEL_BYTES) -> dict[str, bytes]:
    """Dictionary content for each language of docs (doc_id, text, lang); null texts, languages and ids are left out.

    The sample of a language is its sample_docs documents with the smallest
    hash of doc_id and text, rows that repeat counted once. Each lends the same
    number of bytes, from all over its text, so that the dictionary is filled;
    short texts lend what they have. Where there are so many languages that
    dictionaries of that size exceed model_bytes together, all are smaller.
    """
    small_batches(docs.sparkSession)
    known = docs.where("doc_id is not null and lang is not null and text is not null")
    known = known.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = cut(known.groupBy("lang").agg(F.count(F.lit(1)).alias("all")))
    languages = max(1, sizes.count())
    each = min(dictionary_bytes, model_bytes // languages)
    few = known.join(broadcast_if_small(sizes), "lang").where(few_smallest(F.col("h"), sample_docs, F.col("all")))
    ranked = few.select("lang", "h").distinct().withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h")))
    chosen = cut(ranked.where(F.col("n") <= sample_docs))
    # Bytes of a document: more where few are known, so that they fill the dictionary all the same.
    wanted = chosen.join(F.broadcast(chosen.groupBy("lang").agg(F.max("n").alias("known"))), "lang").select("lang", "h", F.ceil(F.lit(each) / F.col("known")).cast("int").alias("bytes"))
    rows = known.join(broadcast_if_small(wanted), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes_, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([spread(t, n) for t, n in zip(texts, sizes_, strict=True)], pa.binary())], ["lang", "h", "content"])

    found = rows.select("lang", "h", "bytes", as_bytes(F.col("text")).alias("data")).mapInArrow(snippets, "lang string, h long, content binary").toArrow()
    content: dict[str, list[bytes]] = {}
    for r in found.sort_by([("lang", "ascending"), ("h", "ascending")]).to_pylist():
        content.setdefault(r["lang"], []).append(r["content"])
    return {lang: b" ".join(parts) for lang, parts in content.items()}


class Compressors:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(content)
        self.each = [self._one(content[lang], level) for lang in self.langs]
        self.words = [frozenset(content[lang].split()) for lang in self.langs]

    @staticmethod
    def _one(content: bytes, level: int):
        held = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=held, level=level, write_content_size=False, write_dict_id=False, write_checksum=False).compress

    def predict(self, data: bytes | None) -> tuple[str, float]:
        """Language and margin: the share of bytes saved against the second best language."""
        if not data or not self.langs or not has_letter(data):
            return UNKNOWN, 0.0
        sizes = [0] * len(self.each)
        for part in pieces(data):
            folded = fold(part)
            for at in range(0, len(folded), PIECE):
                piece = folded[at : at + PIECE]
                for k, compress in enumerate(self.each):
                    sizes[k] += len(compress(piece))
        best = min(sizes)
        if len(sizes) == 1:
            return self.langs[0], 1.0
        if sizes.count(best) > 1:  # mostly texts of a few words; of equal sizes, the language that knows more of the words
            near = [(-sum(w in known for part in pieces(data) for w in fold(part).split()), lang) for size, known, lang in zip(sizes, self.words, self.langs, strict=True) if size == best]
            return min(near)[1], 0.0
        return self.langs[sizes.index(best)], 1 - best / sorted(sizes)[1]


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, level: int = LEVEL) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row a document; score is the margin, 0 to 1.

    Null texts and texts without a letter are `und` with score 0 and rejected,
    as is every text if no language was learned. Long texts are compressed to
    their end, piece by piece. Equal sizes go to the language that knows more
    of the words, then to the first by code point, with score 0. Rows that
    repeat give equal rows; an empty table gives none.
    """
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(content, level)
        for ids, texts in id_and_bytes(batches):
            found = [compressors.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("data"))
    return rows.mapInArrow(compute, "doc_id long, lang_pred string, score double").withColumn("rejected", F.col("score") < margin)
