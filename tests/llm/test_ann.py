import numpy as np

from slopewise.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double, block int"


def brute(rows, queries, k=5):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(i, set()).add(tuple(np.float32(v).astype(float)))
    out = []
    for q in sorted({i for i, _ in queries if i in good}):
        a = np.array(min(good[q]))
        best = sorted((-max(float(a @ np.array(v) / np.sqrt((a @ a) * (np.array(v) @ np.array(v)))) for v in vs), i) for i, vs in good.items() if i != q)[:k]
        out += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(best)]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], SCHEMA)
    got = ann.search(df, df.where("vec_id % 50 = 0"), **options)
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect())


def test_small_tables_are_exact_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(160)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # ties, more than are asked for
    rows += [(200, None), (250, [0.0] * 6), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (350, [float("nan")] * 6), (400, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (450, []), (None, rows[0][1]), rows[0], rows[0], (100, rows[7][1])]
    assert run(spark, rows) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0])


def test_other_lengths_few_rows_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [1.0, 2.0, 3.0]), (50, [3.0, 2.0, 1.0]), (100, [1.0]), (150, [-1.0]), (3, [2.0])]
    assert [(q, r, v) for q, r, v, _ in run(spark, rows)] == [(0, 1, 1), (50, 1, 2), (100, 1, 3), (100, 2, 150), (150, 1, 3), (150, 2, 100)]
    assert run(spark, []) == []
    assert run(spark, [(50, [0.0, 0.0])]) == []


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(6000)]
    got = run(spark, rows, part=512, chunk=64)
    unit = np.array([v for _, v in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & {v for a, _, v, _ in got if a == q})
    assert len(got) == 600 and hits / 600 >= 0.9


def test_search_measures_what_files_and_footrule_say(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((400, 5)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], SCHEMA)
    model = ann.learn(df.selectExpr("vec_id", "embedding v"), 0.0, 24)[5]
    assert len(model.units) == 24 and len(model.sample) == 400
    got = ann.search(df, df.where("vec_id % 50 = 0"), posted=3, probed=4, part=50, chunk=3, per_root=0.0, least_pivots=24).collect()
    units = ann.unit(vectors.astype(float))
    order = [sorted(range(24), key=lambda p: -float(u @ model.units[p])) for u in units]
    footrule = lambda a, b: sum(abs(order[a].index(p) - order[b].index(p)) for p in range(24))
    for q in range(0, 400, 50):
        radius = sorted(footrule(q, e) for e in range(400))[round(ann.NEAR / 20 * 400) - 1]
        near = [e for e in range(400) if set(order[e][:3]) & set(order[q][:4]) and footrule(q, e) <= radius]
        score = {e: float(units[e].astype(float) @ units[q]) for e in near if e != q}
        own = sorted([r for r in got if r.query_id == q], key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == sorted(score, key=lambda e: -score[e])[:5]
        assert {r.measured for r in own} == {len(near)}


def test_scores_are_the_plain_measure():
    rng = np.random.default_rng(5)
    a, q = rng.standard_normal((50, 7)), rng.standard_normal(7)
    want = [float(np.dot(v, q)) / (float(np.sqrt(np.dot(v, v))) * float(np.sqrt(np.dot(q, q)))) for v in a]
    assert np.allclose(ann.cosines(a, q), want, rtol=0, atol=4e-16)
    assert np.allclose(ann.cosines(a * 1e200, q * 1e200), want, rtol=0, atol=1e-15) and np.allclose(ann.cosines(a * 1e-200, q), want, rtol=0, atol=1e-15)
