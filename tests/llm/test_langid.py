import random

import pytest
import zstandard
from pyspark.sql import functions as F

from slopewise.llm import langid
from slopewise.session import table

DE = "der Hund und die Katze gehen durch den Garten zum alten Haus am Fluss ".split()
EN = "the dog and the cat walk through this garden to an old house by the river ".split()


def plain_sizes(content, text):
    """Bytes of the whole lower-cased text in pieces, with each dictionary, by a fresh compressor each time."""
    words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split()
    data = " ".join(words).encode()
    out = {}
    for lang, held in content.items():
        dictionary = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=langid.LEVEL)
        size = 0
        for at in range(0, len(data), langid.PIECE):
            size += len(zstandard.ZstdCompressor(dict_data=dictionary, level=langid.LEVEL, write_content_size=False, write_dict_id=False).compress(data[at : at + langid.PIECE]))
        out[lang] = size
    return out


def test_held_out_accuracy_over_all_lengths(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    learn = langid.learnable(F.col("doc_id"))
    content = langid.fit(docs.where(learn))
    rows = docs.where(~learn).where("lang is not null and text is not null")
    found = langid.identify(rows, content).join(rows.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(found) > 250
    assert sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)
    for r in found[::7]:  # the same answer as plain compression of the whole text
        sizes = sorted((n, lang) for lang, n in plain_sizes(content, r.text).items())
        if sizes[0][0] < sizes[1][0]:
            assert r.lang_pred == sizes[0][1] and r.score == 1 - sizes[0][0] / sizes[1][0]


def test_long_text_is_not_decided_by_one_sentence():
    rng = random.Random(3)
    content = {"de": " ".join(rng.choices(DE, k=400)).encode().lower(), "en": " ".join(rng.choices(EN, k=400)).encode()}
    german = " ".join(rng.choices(DE, k=2000))
    english = "Some unknown people walk through the garden of this old house by the river and watch a very lazy dog."
    lang, margin = langid.Compressors(content).predict(f"{german} {english}".encode())
    assert lang == "de" and margin > 0.1
    assert langid.Compressors(content).predict((f"{german} " * 400 + english).encode())[0] == "de"


def test_snippets_lie_evenly_over_the_whole_text():
    text = " ".join(f"{'abcdefghij'[i // 1000]}word" for i in range(10_000)).encode()
    held = langid.spread(text, 2560)
    assert 2560 <= len(held) <= 2560 + 20 and all(f"{c}word".encode() in held for c in "abcdefghij")
    assert langid.spread(text, 100) in text and langid.spread(b"A b", 100) == b"a b"


def test_odd_texts(spark):
    train = spark.createDataFrame([(1, "the house and the garden " * 20, "en"), (1, "the house and the garden " * 20, "en"), (2, "das Haus und der Garten " * 20, "de"), (3, None, "en"), (None, "x", "fr"), (4, "la maison", None)], "doc_id long, text string, lang string")
    content = langid.fit(train)
    assert sorted(content) == ["de", "en"] and content["en"].count(b"house") == 20
    assert all(len(c) <= 33 for c in langid.fit(train, model_bytes=64).values())
    rows = [(1, None), (2, ""), (3, "123 !!! ²"), (4, "THE GARDEN AND THE HOUSE"), (5, "der Garten und das Haus"), (5, "der Garten und das Haus"), (None, "der Garten"), (7, "Ж"), (8, "das Haus " * 600_000)]
    df = spark.createDataFrame([(i, t, "xx", 1) for i, t in rows], "doc_id long, text string, lang string, score int")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df, content).collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")]
    assert got[3:7] == [(4, "en"), (5, "de"), (5, "de"), (None, "de")]
    assert got[7][1] in ("de", "en") and got[8] == (8, "de")
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}
    assert langid.identify(df.limit(0), content).collect() == []
    assert langid.fit(train.limit(0)) == {}


@pytest.mark.parametrize("text", ["Ünder", "ABC déf.. 12 g", "", "..", "ÀÉ x\ny"])
def test_fold_keeps_only_small_letters(text):
    folded = langid.fold(text.encode()).decode()
    assert folded == folded.lower() and not any(c.isascii() and not (c.isalpha() or c == " ") for c in folded)


def test_fold_keeps_every_word_in_order():
    assert langid.fold(b"Der Hund, der DER hund") == b"der hund der der hund"
