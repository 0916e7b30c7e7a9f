import random

from slopewise.llm import licence_texts, licences
from slopewise.llm.licences import WORD
from tests.llm import brute

PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def base(text):
    words = WORD.findall(brute.lower(text or ""))
    places = []
    for label, phrase in PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def longest_runs(scanner, words):
    """For each place the longest run ending there that stands in a template."""
    runs = {tuple(s[a:b]) for s in scanner.sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(words))]


def test_base_places_match_plain_search(spark):
    rng = random.Random(1)
    pool = "under the mit license apache version 2 cc by nc THE MIT License, Version 2.0 é über x".split()
    texts = [" ".join(rng.choices(pool, k=rng.choice([0, 3, 30, 200]))) for _ in range(120)]
    texts += [None, "", " \x00\t", "under the mit license under the MIT License", "Licensed under CC BY-NC 4.0.", "cc\x7fby\x00nc", "undér the mit license", "word " * 60_000 + "Apache License, Version 2.0"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licences.scan_licences(df.limit(0)).collect() == []


def walk(auto, words):
    """Length of the longest run that ends at each word."""
    state = run = 0
    for word in words:
        while state and word not in auto.step[state]:
            state = auto.link[state]
            run = auto.length[state]
        if word in auto.step[state]:
            state, run = auto.step[state][word], run + 1
        yield run


def random_text(rng, scanner, n):
    flat = [w for s in scanner.sequences for w in s]
    words = []
    while len(words) < n:
        a = rng.randrange(len(flat))
        words += flat[a : a + rng.choice([1, 2, 5, 9, 30, 80])]
        if rng.random() < 0.3:
            words += [b"noise"] * rng.randrange(1, 12)
    return words


def test_matching_statistics_match_plain_search():
    scanner, rng = licences.Scanner(templates=licence_texts.TEXTS[3:5]), random.Random(2)
    for _ in range(6):
        words = random_text(rng, scanner, 60)
        assert list(walk(scanner.automaton, words)) == longest_runs(scanner, words)


def plain_chain(template, words, need, gap):
    """Most words of the template that a chain of its longest matches covers, all pairs of words and of matches tried."""
    runs = {}
    for i, w in enumerate(words):
        for e, v in enumerate(template):
            if w == v:
                runs[i, e] = runs.get((i - 1, e - 1), 0) + 1
    anchors = sorted((i, e, n) for (i, e), n in runs.items() if n >= need and (i + 1, e + 1) not in runs)
    cover = []
    for k, (i, e, n) in enumerate(anchors):
        best = n
        for (j, f, _), c in zip(anchors[:k], cover, strict=True):
            first, start = i - n + 1, e - n + 1
            over = max(0, j - first + 1, f - start + 1)
            if j < i and f < e and over < n and first - j - 1 <= gap and start - f - 1 <= gap:
                best = max(best, c + n - over)
        cover.append(best)
    return max(cover, default=0)


def test_chains_match_plain_search():
    scanner, rng = licences.Scanner(), random.Random(5)
    texts = [random_text(rng, scanner, 150) for _ in range(12)]
    for t in range(scanner.phrases, len(scanner.sequences)):  # whole licences with words changed, left out and put in
        words = [w for v in scanner.sequences[t] for w in ([], [b"other"], [v, b"more"], [v])[min(3, rng.randrange(40))]]
        texts.append([b"before"] * 3 + words + [b"after"])
    held = 0
    for words in texts:
        best = {}
        for t, share, a, b in scanner.scan(b" ".join(words))[2]:
            assert 0 <= a <= b < len(words)
            best[t] = max(best.get(t, 0), round(share * len(scanner.sequences[t])))
        want = {t: plain_chain(scanner.sequences[t], words, scanner.min_run, scanner.max_gap) for t in range(scanner.phrases, len(scanner.sequences))}
        assert best == {t: n for t, n in want.items() if n}
        held += len(best)
    assert held > 60


def test_whole_licences_are_told_apart(spark):
    texts = [t for _, t in licence_texts.TEXTS] + [t for _, t in licence_texts.NAMES]
    labels = [x for x, _ in licence_texts.TEXTS] + [x for x, _ in licence_texts.NAMES]
    mit, two, three = (dict(licence_texts.TEXTS)[x] for x in ("mit", "bsd-2-clause", "bsd-3-clause"))
    texts += [three + " and elsewhere " * 9 + two, mit.replace("obtaining a copy of", "that has one of")[:900], "some words " * 9 + mit[:200], mit + " so " + mit, None]
    labels += ["bsd-2-clause,bsd-3-clause", "mit", "", "mit", ""]
    df = spark.createDataFrame([(i, None if t is None else "x " + t + " y") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    for i, want in enumerate(labels):
        assert set(filter(None, want.split(","))) <= set(filter(None, got[i].labels.split(","))), texts[i]
        if len(texts[i] or "") > 700:
            assert got[i].labels == want, texts[i]
    assert got[len(licence_texts.TEXTS) + len(licence_texts.NAMES) + 2].labels == ""


def test_chains_bridge_small_changes():
    scanner = licences.Scanner()
    notice = dict(licence_texts.TEXTS)["mit"]
    for text, least in ((notice, 1.0), (notice.replace("obtaining a copy of", "obtaining one copy of"), 0.95), ("noise words " * 50 + notice.upper() + " more noise", 1.0)):
        n, places, chains = scanner.scan(text.encode())
        share, label, first, last = max((s, scanner.labels[t], a, b) for t, s, a, b in chains)
        assert label == "mit" and least <= share <= 1
        assert last - first + 1 <= len(licences.words_of(notice.encode())) + 1
    assert all(s < licences.COVERED for _, s, _, _ in scanner.scan(b"the rights to use this software are with the people who wrote it")[2])


def test_like_names_give_one_label_and_a_footer_none(spark, tmp_path):
    texts = ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "This work is licensed under the GNU General Public License, version 3. All rights reserved.", "All rights reserved", "Licensed under CC BY-NC 4.0. Released under the MIT License.", "// SPDX-License-Identifier: Apache-2.0", "Licensed under the BSD license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.base_labels, r.labels) for r in licences.scan_licences(df).collect()}
    assert got == {0: ("", "cc-by-nc"), 1: ("", "cc-by"), 2: ("", "gpl-3.0"), 3: ("", ""), 4: ("cc-by-nc,mit", "cc-by-nc,mit"), 5: ("", "apache-2"), 6: ("", "bsd")}
    (tmp_path / "Own-1.txt").write_text("You may do as you like with this text as long as you tell nobody where it came from.")
    scanner = licences.Scanner(templates=licences.templates_from(str(tmp_path)))
    own = spark.createDataFrame([(1, "so you may do as you like with this text as long as you tell nobody where it came")], "doc_id long, text string")
    assert [r.labels for r in licences.scan_licences(own, scanner=scanner).collect()] == ["own-1"]
