import hashlib
import math
import random

from slopewise.llm import mixing
from tests.llm import brute


def reshare(sizes, total=1.5, most=2.0):
    """Targets by repeated resharing, literally."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    capped, goal = set(), {}
    while True:
        rest = total * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        goal = {s: most * sizes[s] for s in capped} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > most * sizes[s]}
        if not over:
            return goal
        capped |= over


def places_of(goal, bits):
    """The source of each place: where the mirrored bits of its number fall among the targets laid end to end."""
    total, out = sum(goal.values()), []
    for place in range(1 << bits):
        u, at = int(bin(place)[2:].zfill(bits)[::-1], 2) / (1 << bits), 0
        for s, n in goal.items():
            if at / total <= u < (at + n) / total:
                out.append(s)
            at += n
    return out


def plain_mix(rows, block_words=mixing.BLOCK_WORDS, least_bits=mixing.LEAST_BITS):
    """(words, first place) of each pass and the number of places, for each row (doc_id, text, source), word by word of each stream."""
    counts = [len(brute.WORD.findall(t or "")) for _, t, _ in rows]
    sizes = {}
    for (_, _, s), n in zip(rows, counts, strict=True):
        sizes[s] = sizes.get(s, 0) + n
    target = reshare(sizes)
    goal = {s: math.floor(target[s] + 0.5) for s in sorted(target, key=lambda s: (s is None, (s or "").encode()))}
    total = sum(goal.values())
    bits = mixing.place_bits(total, block_words, least_bits)
    schedule = places_of(goal, bits) if total else []
    block = max(total, 1) / 2**bits
    key = lambda r: hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
    passes = [[] for _ in rows]
    for s in sizes:
        stream = [i for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: key(rows[i])) for _ in range(counts[i])]
        for turn, place in enumerate(p for p, owner in enumerate(schedule) if owner == s):
            for w in range(math.floor(turn * block), min(math.floor((turn + 1) * block), 2 * len(stream))):
                passes[stream[w % len(stream)]].append((w // len(stream), place))
    out = []
    for i, (_, _, s) in enumerate(rows):
        each = [[p for e, p in passes[i] if e == number] for number in (0, 1)]
        out.append((counts[i], sizes[s], round(target[s], 6), [(len(x), min(x)) for x in each if x], sum(len(set(x)) for x in each)))
    return out


def test_mix_matches_plain_version(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        source = rng.choice(["b", "b", "b", "b", "a", "Z", "é", None, "", "tiny"][: 9 if i else 10])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 900]))), source))
    rows += [(5, "a b\t\x0bc", "b"), (5, "a b\t\x0bc", "b"), (None, None, None), (900, "one", "tiny"), (None, "x y", "b"), (None, "z y q", "b")]
    df = spark.createDataFrame([(i, t, s, 1, 2.0) for i, t, s in rows], "doc_id long, text string, source string, size int, target double")
    for block, bits in ((64, 4), (mixing.BLOCK_WORDS, mixing.LEAST_BITS), (10**6, 0)):
        got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.first_place, r.places) for r in mixing.mix(df, block_words=block, least_bits=bits).collect()]
        want = [(i, n, m, t, sum(w for w, _ in each), min((p for _, p in each), default=None), places) for (i, _, _), (n, m, t, each, places) in zip(rows, plain_mix(rows, block, bits), strict=True)]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert all(t <= 2 * n for _, n, _, _, t, _, _ in got)
    taken = {}
    for r in mixing.mix(df).collect():
        taken.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 2 for t, n in taken.values())


def test_equal_rows_are_laid_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 3)
    rows = [(7, "a b", "s")] * 11 + [(8, "c", "s"), (9, "d e f", "t"), (None, "", "t"), (None, "", "t"), (None, "", "t"), (None, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.size, r.taken, r.first_place, r.places) for r in mixing.mix(df).collect()]
    want = [(i, n, sum(w for w, _ in each), min((p for _, p in each), default=None), places) for (i, _, _), (n, _, _, each, places) in zip(rows, plain_mix(rows), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_schedule_gives_each_source_its_share_of_any_beginning(spark):
    plan = spark.createDataFrame([(1, 6000.0), (2, 3000.0), (3, 500.0), (4, 0.0), (5, 3.0)], "source_no long, target double")
    slots = sorted((r.place, r.source_no, r.turn) for r in mixing.schedule(plan, 12).collect())
    assert [p for p, _, _ in slots] == list(range(4096))
    assert [s for _, s, _ in slots] == places_of({1: 6000, 2: 3000, 3: 500, 4: 0, 5: 3}, 12)
    for no, n in ((1, 6000), (2, 3000), (3, 500), (4, 0), (5, 3)):
        turns = [t for _, s, t in slots if s == no]
        assert turns == list(range(len(turns))) and abs(len(turns) - 4096 * n / 9503) < 1
        for upto in (100, 500, 3000):
            assert abs(sum(s == no for _, s, _ in slots[:upto]) - upto * n / 9503) < 6


def test_mixed_documents_stand_in_the_order_of_their_places(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{i}" for _ in range(rng.choice([0, 3, 30, 200]))), rng.choice(["a", "a", "a", "b", None]), i) for i in range(200)]
    rows += [(3, "x y z", "a", 1), (3, "x y z", "a", 2), (3, "x y z", "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place int")
    mixing.mixed_documents(df).write.parquet(f"{tmp_path}/mix")
    got = [tuple(r) for f in sorted(tmp_path.glob("mix/*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    copies = sorted((place, r[0], r[2]) for r, (_, _, _, each, _) in zip(rows, plain_mix([r[:3] for r in rows]), strict=True) for _, place in each)
    assert [(i, s) for _, i, s in copies if i != 3] == [(r[0], r[2]) for r in got if r[0] != 3]
    assert sorted(r[0] for r in got) == sorted(i for _, i, _ in copies) and set(got) <= set(rows)
    part = got[: len(got) // 2]
    share = lambda docs, s: sum(len(r[1].split()) for r in docs if r[2] == s) / sum(len(r[1].split()) for r in docs)
    assert all(abs(share(part, s) - share(got, s)) < 0.15 for s in ("a", "b", None))


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken, r.first_place, r.places) for r in mixing.mix(blank).collect()) == [(1, 0, 0.0, 0, None, 0), (2, 0, 0.0, 0, None, 0)]
    assert mixing.mixed_documents(blank).collect() == []
