import math

import numpy as np
from pyspark.sql import functions as F

from slopewise.llm import quality
from slopewise.session import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    learn = ~quality.held_out(F.col("doc_id"))
    model = quality.fit(docs.where(learn), labels.where(learn))
    found = quality.score(docs, model).join(labels, "doc_id").where(~learn).collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) >= 0.98
    assert sum(1 - r.predicted for r in bad) / len(bad) >= 0.85


def plain_score(model, x):
    """Gated attention over the passages, written out passage by passage."""
    h = [[math.tanh(sum(float(f) * float(w) for f, w in zip(row, column, strict=True))) for column in model.w.T] for row in x]
    act = lambda code, gate, f: [f(sum(c * float(w) for c, w in zip(code, column, strict=True))) for column in gate.T]
    e = [sum(t * s * float(a) for t, s, a in zip(act(code, model.v, math.tanh), act(code, model.u, lambda y: 1 / (1 + math.exp(-y))), model.a, strict=True)) for code in h]
    weight = [math.exp(y - max(e)) for y in e]
    z = [sum(w * code[k] for w, code in zip(weight, h, strict=True)) / sum(weight) for k in range(len(h[0]))]
    return 1 / (1 + math.exp(-sum(v * float(c) for v, c in zip(z, model.c, strict=False)) - float(model.c[-1])))


def small_model(seed=2):
    rng = np.random.default_rng(seed)
    shapes = {"w": (quality.FEATURES, 5), "v": (5, 3), "u": (5, 3), "a": (3,), "c": (6,)}
    return quality.AttentionModel(**{k: rng.standard_normal(s) * 0.7 for k, s in shapes.items()})


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    x, starts, y = rng.random((9, quality.FEATURES)) / 5, np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss(model):
        p = model.forward(x, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    model = small_model()
    grads = model.gradients(x, starts, y)
    for name, grad in grads.items():
        param = getattr(model, name)
        for at in rng.choice(param.size, min(param.size, 12), replace=False):
            step, held = 1e-5, param.flat[at]
            param.flat[at] = held + step
            above = loss(model)
            param.flat[at] = held - step
            below = loss(model)
            param.flat[at] = held
            assert abs((above - below) / (2 * step) - grad.flat[at]) < 1e-7, name


def test_training_lowers_the_loss_and_weights_add_up():
    rng = np.random.default_rng(1)
    bags, y = [rng.random((n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 5)], np.array([1.0, 0.0, 1.0], np.float32)
    x, starts = np.concatenate(bags), np.array([0, 1, 4])
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    before, after = quality.train(bags, y, epochs=1, rate=0.0), quality.train(bags, y, epochs=60, rate=0.01)
    assert loss(after.forward(x, starts)["p"]) < 0.2 * loss(before.forward(x, starts)["p"])
    assert np.allclose(np.add.reduceat(after.forward(x, starts)["weight"], starts), 1)


def test_scores_match_a_plain_version(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").limit(40).collect()
    model = small_model()
    for r in docs:
        data = (r.text or "").encode()
        assert abs(model.score(data) - plain_score(model, quality.encode(data))) < 1e-5
    # Many pieces, weighed as they come, are as one.
    long = " ".join(r.text or "" for r in docs).encode()
    monkeypatch.setattr(quality, "PIECE", 1024)
    assert len(list(quality.encoded(long))) > 10
    assert abs(model.score(long) - plain_score(model, quality.encode(long))) < 1e-5


def test_fit_takes_whole_documents_and_bounds_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, y, **_: seen.append((bags, y)))
    rows = [(i, f"text number {i} " * (40 * i)) for i in range(1, 30)] + [(5, "text number 5 " * 200), (5, "another text"), (5, "another text"), (None, "no id"), (40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)] + [(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    quality.fit(docs, labels)
    bags, y = seen[-1]
    distinct = {(i, t) for i, t in rows if i is not None}
    assert sorted(map(len, bags)) == sorted(len(quality.encode((t or "").encode())) for _, t in distinct) and max(map(len, bags)) > 16
    assert sorted(y) == sorted(float(i % 2 and i != 1) for i, _ in distinct)
    quality.fit(docs, labels, sample_docs=7)
    assert len(seen[-1][0]) == 7
    quality.fit(docs, labels, sample_bytes=30_000)
    assert 0 < sum(map(len, seen[-1][0])) <= 30_000 // quality.PASSAGE + len(seen[-1][0])


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n", 5), (3, " \n", 5), (None, "word", 5), (4, "x" * 200_000, 5), (5, "long text " * 300_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = quality.train([quality.encode(b"good words here"), quality.encode(b"### !!! ###")] * 8, np.array([1.0, 0.0] * 8, np.float32))
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    none = quality.fit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None and {r.score for r in quality.score(df, none).collect()} == {0.5}
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_passages_of_long_texts_are_those_of_its_pieces():
    data = b"some words 12 " * 200_000
    assert len(quality.encode(data)) >= len(data) // quality.PASSAGE - 4
    assert quality.encode(b"").shape == (1, quality.FEATURES)
