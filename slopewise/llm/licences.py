"""License scans by matching statistics over a generalised suffix automaton.

The automaton holds every run of words of every template. A text is streamed
through it word by word, which gives for each place the longest run ending
there that some template holds. Where that is MIN_RUN words or more, the runs
of each single template are followed until they can go no further; these
longest matches are anchors. Anchors that follow each other in text and
template are chained, and a chain that covers enough of its template labels the
document, unless another chain covers more words of the same place. Names of
licences count where they stand whole; their places, like those of the base
phrases, are read off the same walk, from the states whose run ends in them.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewise.llm.common import as_bytes, id_and_bytes, pieces, small_batches
from slopewise.llm.licence_texts import NAMES, TEXTS

MIN_RUN = 4
#: Most words that may be skipped between two anchors of a chain, in the text and in the template.
MAX_GAP = 8
#: Share of a template that a chain must cover for its label.
COVERED = 0.8

# Base phrases with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Lower-cases A-Z and turns every ASCII byte that is neither a letter nor a digit into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def templates_from(folder: str) -> tuple[tuple[str, str], ...]:
    """(label, text) of each file of a folder on the driver, labelled by its name without the suffix, in small letters."""
    return tuple((p.stem.lower() if p.suffix == ".txt" else p.name.lower(), p.read_text(errors="replace")) for p in sorted(Path(folder).iterdir()) if p.is_file())


@dataclass
class Automaton:
    """Suffix automaton of several word sequences."""

    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: For each state, the phrases that its longest run ends in, with their words.
    phrases: list[list[tuple[int, int]]] = field(default_factory=list)

    def _state(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, source: int, word: bytes) -> int:
        """The state that source leads to by word, with exactly one word more than source."""
        target = self.step[source][word]
        if self.length[target] == self.length[source] + 1:
            return target
        copy = self._state(self.length[source] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while source >= 0 and self.step[source].get(word) == target:
            self.step[source][word] = copy
            source = self.link[source]
        return copy

    def extend(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    @classmethod
    def of(cls, sequences: list[list[bytes]], phrases: int) -> Automaton:
        """The first so many sequences are the phrases."""
        self = cls()
        for words in sequences:
            last = 0
            for word in words:
                last = self.extend(last, word)
        home: dict[int, list[tuple[int, int]]] = {}
        for number, p in enumerate(sequences[:phrases]):
            home.setdefault(self.walk(p), []).append((number, len(p)))
        for state in range(len(self.step)):
            found, at = [], state
            while at > 0:
                found += home.get(at, [])
                at = self.link[at]
            self.phrases.append(found)
        return self

    def walk(self, words: list[bytes]) -> int:
        at = 0
        for w in words:
            at = self.step[at][w]
        return at


@dataclass
class Chain:
    """Words of its template that a chain covers, and the last of them; the first and last word of the text under it."""

    cover: int
    last: int
    upto: int
    first: int


@dataclass
class Scanner:
    templates: tuple[tuple[str, str], ...] = TEXTS
    names: tuple[tuple[str, str], ...] = NAMES
    base: tuple[tuple[str, str], ...] = BASE
    min_run: int = MIN_RUN
    max_gap: int = MAX_GAP
    covered: float = COVERED

    def __post_init__(self) -> None:
        pairs = [(label, words_of(p.encode())) for p, label in self.base] + [(label, words_of(p.encode())) for label, p in self.names]
        self.phrases = len(pairs)
        pairs += [(label, w) for label, t in self.templates if len(w := words_of(t.encode())) >= self.min_run]
        self.labels, self.sequences = [label for label, _ in pairs], [w for _, w in pairs]
        self.automaton = Automaton.of(self.sequences, self.phrases)
        self.vocabulary = frozenset(w for s in self.sequences for w in s)
        #: Where each run of min_run words ends in the templates.
        self.grams: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for t, words in enumerate(self.sequences[self.phrases :], self.phrases):
            for end in range(self.min_run - 1, len(words)):
                self.grams.setdefault(tuple(words[end + 1 - self.min_run : end + 1]), []).append((t, end))

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, float, int, int]]]:
        """Number of words; places of base phrases and names (phrase, first word); chains (template, share, first and last word).

        Of each template these are its best chain and, besides, those that cover
        enough of it at other places of the text.
        """
        total = 0
        places: list[tuple[int, int]] = []
        open_chains: dict[int, list[Chain]] = {}
        found: dict[int, list[Chain]] = {}
        step, link, length, phrases = self.automaton.step, self.automaton.link, self.automaton.length, self.automaton.phrases
        known, need = self.vocabulary, self.min_run
        state = run = 0
        previous = -1
        recent: list[bytes] = []
        #: Matches that end at the last word: where in which template, and how long they are.
        matches: dict[tuple[int, int], int] = {}
        for piece in pieces(data):
            words = words_of(piece)
            for place in [i for i, w in enumerate(words) if w in known]:
                at, word = total + place, words[place]
                if run and at != previous + 1:
                    state = run = 0
                    recent = []
                while state and word not in step[state]:
                    state = link[state]
                    run = length[state]
                state, run = step[state][word], run + 1
                recent = [*recent[1 - need :], word]
                grown: dict[tuple[int, int], int] = {}
                if run >= need:
                    grown = {(t, e): matches.get((t, e - 1), need - 1) + 1 for t, e in self.grams.get(tuple(recent[-need:]), ())}
                if matches:
                    for (t, e), n in matches.items():
                        if (t, e + 1) not in grown:
                            self._anchor(t, previous, e, n, open_chains, found)
                matches = grown
                for phrase, n in phrases[state]:
                    if n <= run:
                        places.append((phrase, at - n + 1))
                previous = at
            total += len(words)
        for (t, e), n in matches.items():
            self._anchor(t, previous, e, n, open_chains, found)
        return total, places, [(t, c.cover / len(self.sequences[t]), c.first, c.last) for t, chains in sorted(found.items()) for c in chains]

    def _anchor(self, t: int, at: int, end: int, run: int, open_chains: dict[int, list[Chain]], found: dict[int, list[Chain]]) -> None:
        """Takes a longest match of a template, both of whose last words are given, into the chains of the template."""
        whole = len(self.sequences[t])
        # A later match may begin as much earlier as the template is long.
        near = [c for c in open_chains.get(t, ()) if c.last + self.max_gap >= at - whole]
        first, start = at - run + 1, end - run + 1
        top = Chain(run, at, end, first)
        for c in near:
            overlap = max(0, c.last - first + 1, c.upto - start + 1)
            if overlap < run and first - c.last - 1 <= self.max_gap and start - c.upto - 1 <= self.max_gap and c.last < at and c.upto < end and c.cover + run - overlap > top.cover:
                top = Chain(c.cover + run - overlap, at, end, c.first)
        open_chains[t] = [*near, top]
        best = found.setdefault(t, [])
        if best and (top.first <= best[-1].last or best[-1].cover < self.covered * whole):
            if top.cover > best[-1].cover:
                best[-1] = top
        elif not best or top.cover >= self.covered * whole:
            best.append(top)

    def labelled(self, places: list[tuple[int, int]], chains: list[tuple[int, float, int, int]]) -> set[str]:
        """Labels of the names, and of the chains that cover enough; where they share words of the text, of those only the one that covers most words."""
        spans = [(len(self.sequences[p]), p, a, a + len(self.sequences[p]) - 1) for p, a in places]
        spans += [(round(share * len(self.sequences[t])), t, a, b) for t, share, a, b in chains if share >= self.covered]
        taken: list[tuple[int, int]] = []
        labels = set()
        for _, t, first, last in sorted(spans, key=lambda s: (-s[0], s[1], s[2])):
            at = bisect(taken, (first,))
            if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
                taken.insert(at, (first, last))
                labels.add(self.labels[t])
        return labels


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base and first_word to base_labels are of the base phrases alone. spans
    lists (label, coverage, first_word, last_word) of names, of the best chain
    of each template that has one, and of chains elsewhere that cover enough;
    score is the largest coverage. Of two that cover equally many words of a
    place, the earlier template labels it. Null and empty texts have no words;
    long ones are read to their end, piece by piece. Rows that repeat give
    equal rows; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    scanner = scanner or Scanner()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_and_bytes(batches):
            rows = []
            for t in texts:
                n, places, chains = scanner.scan(t or b"")
                own = [(p, a) for p, a in places if p < len(scanner.base)]
                starts = [a for _, a in own]
                base = {scanner.labels[p] for p, _ in own}
                labels = base | scanner.labelled(places, chains)
                named = [(p, 1.0, a, a + len(scanner.sequences[p]) - 1) for p, a in places if p >= len(scanner.base)]
                spans = [{"label": scanner.labels[t], "coverage": share, "first_word": a, "last_word": b} for t, share, a, b in sorted(named + chains, key=lambda c: (c[2], c[3], c[0]))]
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((s["coverage"] for s in spans), default=1.0 if base else 0.0), spans))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), k) for c, k in zip(columns, types, strict=True)]], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, coverage: double, first_word: long, last_word: long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("data")).mapInArrow(compute, schema)


#: The contract's definition of a word, for tests.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
