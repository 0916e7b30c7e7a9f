import collections

from slopewise.llm import linededup
from tests.llm import brute

BLANK = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=40, min_docs=5):
    held = collections.defaultdict(set)
    key = lambda line: brute.lower(line.strip(BLANK))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    low = lambda i: (i is not None, i or 0)
    gone = {k: max(ids, key=low) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_lines_match_plain_version(spark):
    common, other, wide = "This very common line has well over forty characters.", "x" * 40, "é" * 39
    rows = [(i, f"own line {i}\n  {common.upper() if i % 2 else common}\t\n{other}\n{wide}\n{common}") for i in range(1, 7)]
    rows += [(8, other + "\n" + other), (None, other), (None, other + "\nz"), (9, None), (10, ""), (11, "\n\n"), (1, rows[0][1]), (1, common), (12, "y" * 100_000 + "\n" + "\n".join(f"{n} {common}" for n in range(3000)))]
    df = spark.createDataFrame([(i, t, 3, "k") for i, t in rows], "doc_id long, text string, n_lines int, key string")
    got = sorted((str(r.doc_id), r.kept, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(df).collect())
    assert got == plain(rows)
    assert linededup.dedup_lines(df.limit(0)).collect() == []
