import random

import pytest

from slopewise.llm import common, langid, licences, simhash
from tests.llm import brute


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_hold_every_word_once(monkeypatch, size):
    rng = random.Random(size)
    pool = ["under", "the", "MIT", "license", "é", "x" * 40, "a,b", "cc", "by-nc", "Apache", "License,", "version", "2"]
    for _ in range(60):
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "\t ", "\x0b\r", " "]) for _ in range(rng.randrange(60)))
        data = text.encode()
        whole = [f(data) for f in (simhash.simhash, langid.fold, licences.Scanner().scan)]
        assert b"".join(common.pieces(data, size)) == data
        with monkeypatch.context() as m:
            for module in (simhash, langid, licences):
                m.setattr(module, "pieces", lambda d: common.pieces(d, size))
            assert [f(data) for f in (simhash.simhash, langid.fold, licences.Scanner().scan)] == whole
        assert whole[0] == brute.fingerprint(text)


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), f"{rng.randrange(16):x}", i, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, r string, i int, v long")
    got = {x.i: (x.s, x.p) for x in common.running(df, ["g"], "r", ["r", "i"], "v", "s", "p").collect()}
    for g in ("a", "b", None):
        total = 0
        for place, (_, _, i, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2]))):
            assert got[i] == (total, place)
            total += v
