"""License scans: fixed phrases, and a set-similarity join of text blocks with
license templates.

``identified`` knows the clauses of license bodies, their headers and usual notices.
A block is any run of words, across lines, as long as the clause and a quarter; it
meets the clause when it holds at least four fifths of its words, and the phrases
that tell it from the clauses of other licenses. ``scanned`` is the plain join: a
block is a line of any length, a template the set of words of one notice.

The join orders words by their frequency in the whole corpus, rare ones first, and
finds every such block:

* **prefix:** with ``need`` of its ``t`` words in the block, one of the template's
  ``t - need + 1`` rarest words must be there;
* **length:** a block with fewer distinct words than ``need`` can't meet it;
* **position:** the words of both that come after the first shared one must be
  enough for the rest.

Only words of templates can be shared, so frequencies are counted for these. A run of
words holds no more of a clause than its whole text does, so ``identified`` joins
whole texts first and slides the window over the clauses left."""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import byte_column, mapped, per_text, slices

#: Phrases that always count, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: License notices by label: usual wordings, of which a block may hold a part.
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "gpl": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Share of a template's words a block must hold, in percent.
CONTAINMENT = 80
#: A window has a clause's words and this share more, in percent.
SLACK = 25
#: Words before "general public license" that make it another license.
KINDS = {b"lesser": "lgpl", b"library": "lgpl", b"affero": "agpl"}
#: A-Z become a-z; ASCII bytes that are neither letters nor digits become spaces,
#: line breaks a line feed.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LINES = bytes(10 if b == 10 else c for b, c in enumerate(_WORDS))


@dataclass(frozen=True)
class Clause:
    """A part of a license: its words, and the phrases that a block must hold."""

    label: str
    words: tuple[bytes, ...]
    required: tuple[tuple[bytes, ...], ...] = ()

    @classmethod
    def of(cls, label: str, text: str, required: list[str] | tuple[str, ...] = ()) -> Clause:
        cut = lambda t: tuple(t.encode().translate(_WORDS).split())
        return cls(label, cut(text), tuple(cut(r) for r in required))

    @property
    def window(self) -> int:
        return len(self.words) + -(-SLACK * len(self.words) // 100)


def notices() -> list[Clause]:
    """Usual wordings of one sentence; each requires the name, as the license that is
    granted and not one that is spoken of, and the version."""
    out = []
    for text in ("Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0"):
        out.append(Clause.of("apache", text, ["under the apache license", "2 0"]))
    for how in ("Released under", "Licensed under", "This project is licensed under", "Distributed under the terms of"):
        tail = "terms of the" if how.endswith("terms of") else "under the"
        out += [Clause.of(label, f"{how} the {name}", [f"{tail} {name.lower()}"]) for label, name in (
            ("mit", "MIT License"), ("bsd", "BSD License"), ("bsd", "BSD 2 Clause License"), ("bsd", "BSD 3 Clause License"), ("bsd", "BSD 4 Clause License"), ("isc", "ISC License"))]
        out += [Clause.of("mpl", f"{how} the Mozilla Public License, version {v}", [f"{tail} mozilla public license", v]) for v in ("1.1", "2.0")]
        for label, kind, versions in (("gpl", "", "123"), ("lgpl", "Lesser ", ("2.1", "3")), ("lgpl", "Library ", "2"), ("agpl", "Affero ", "3")):
            name = f"GNU {kind}General Public License"
            out += [Clause.of(label, f"{how} the {name}, version {v}", [f"{tail} {name}", f"version {v}"]) for v in versions]
    out.append(Clause.of("bsd", TEMPLATES["bsd"], ["redistribution and use"]))
    out.append(Clause.of("mpl", TEMPLATES["mpl"], ["mozilla public license", "2 0"]))
    for v in (1, 2, 3):
        out.append(Clause.of("gpl", f"This work is licensed under the GNU General Public License, version {v}", ["under the gnu general public license", f"version {v}"]))
    for kind, long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"),
                       ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append(Clause.of(f"cc-{kind}", f"Licensed under CC {kind} {v}", [f"cc {kind} {v.removesuffix('.0')}"]))
            out.append(Clause.of(f"cc-{kind}", f"licensed under a Creative Commons {long} {v} International License", [f"commons {long} {v.removesuffix('.0')}"]))
    return out


@cache
def clauses() -> list[Clause]:
    """The notices, and the clauses of bodies and headers in licenses.json, which
    tools/license_clauses.py makes."""
    with open(os.path.join(os.path.dirname(__file__), "licenses.json"), encoding="utf-8") as held:
        return notices() + [Clause.of(*c) for c in json.load(held)]


def best_window(clause: Clause, words: list[bytes], places: dict[bytes, list[int]], need: int) -> tuple[float, int, int] | None:
    """Of all windows of ``clause.window`` words that hold ``need`` of the clause's
    words and every required phrase: the largest containment, with the first and
    last word of the clause there. The leftmost of equals; None without any.

    Only windows that end at a word of the clause are formed: moved left to the last
    such word, any other window loses nothing."""
    own = set(clause.words)
    ends = []
    for phrase in clause.required:
        at = [p for p in places.get(phrase[0], ()) if tuple(words[p:p + len(phrase)]) == phrase]
        if not at:
            return None
        ends.append((len(phrase), at))
    hits = sorted((p, w) for w in own for p in places.get(w, ()))
    inside: Counter[bytes] = Counter()
    first, best = 0, None
    for last, word in hits:
        inside[word] += 1
        start = last - clause.window + 1
        while hits[first][0] < start:
            gone = hits[first][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            first += 1
        if len(inside) < need or (best and len(inside) <= best[0]):
            continue
        if all(_within(start, last, size, at) for size, at in ends):
            best = (len(inside), hits[first][0], last)
    return best and (best[0] / len(own), best[1], best[2])


def _within(start: int, last: int, size: int, at: list[int]) -> bool:
    """Whether a phrase of ``size`` words that begins at one of ``at`` lies whole in
    the words from ``start`` to ``last``."""
    k = bisect_left(at, start)
    return k < len(at) and at[k] + size - 1 <= last


class Matcher:
    """The join of whole texts with clauses, then the windows of those that are met."""

    def __init__(self, known: list[Clause], counts: dict[str, int], percent: int = CONTAINMENT):
        self.clauses = known
        self.side = Templates({str(i): b" ".join(c.words).decode() for i, c in enumerate(known)}, counts, percent)

    def met(self, words: list[bytes]) -> dict[int, tuple[float, int, int]]:
        """The best window of every clause that the text meets, by clause number."""
        if self.side.index.keys().isdisjoint(words):
            return {}
        some = [int(i) for i in self.side.meets(words)]
        wanted = {w for i in some for w in self.clauses[i].words}
        places: dict[bytes, list[int]] = {}
        for at, word in enumerate(words) if some else ():
            if word in wanted:
                places.setdefault(word, []).append(at)
        found = {i: best_window(self.clauses[i], words, places, self.side.need[str(i)]) for i in some}
        return {i: f for i, f in found.items() if f}

    def meets(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """First and last word, label and containment of these windows."""
        return sorted((first, last, self.clauses[i].label, share) for i, (share, first, last) in self.met(words).items())


class Templates:
    """The join's side of templates: word sets in the corpus order, and an index of
    their prefixes."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], percent: int = CONTAINMENT):
        self.sets = {label: set(text.encode().translate(_WORDS).split()) for label, text in sorted(templates.items())}
        words = sorted({w for s in self.sets.values() for w in s}, key=lambda w: (counts.get(w.decode("utf-8", "replace"), 0), w))
        self.rank = {w: i for i, w in enumerate(words)}
        self.need = {label: -(-percent * len(s) // 100) for label, s in self.sets.items()}
        self.size = {label: len(s) for label, s in self.sets.items()}
        self.index: dict[bytes, list[tuple[str, int]]] = {}
        for label, some in self.sets.items():
            for place, word in enumerate(sorted(some, key=self.rank.__getitem__)[:len(some) - self.need[label] + 1]):
                self.index.setdefault(word, []).append((label, place))

    def meets(self, block: list[bytes]) -> dict[str, float]:
        """Containment of every template that the block meets."""
        distinct = set(block)
        known = sorted(distinct & self.rank.keys(), key=self.rank.__getitem__)
        tried, out = set(), {}
        for at, word in enumerate(known):
            for label, place in self.index.get(word, ()):
                need = self.need[label]
                if label in tried or len(distinct) < need or 1 + min(self.size[label] - place - 1, len(known) - at - 1) < need:
                    continue
                tried.add(label)
                common = len(self.sets[label] & distinct)
                if common >= need:
                    out[label] = common / self.size[label]
        return out


def frequencies(docs: DataFrame, templates: dict[str, str]) -> dict[str, int]:
    """Blocks of the whole corpus that hold each word of the templates: a list as
    long as the templates' vocabulary."""
    known = {w for text in templates.values() for w in text.encode().translate(_WORDS).split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(known, 0)
        for batch in slices(batches):
            for text in byte_column(batch, "text"):
                for line in (text or b"").translate(_LINES).split(b"\n"):
                    for word in known.intersection(line.split()):
                        counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in sorted(counts)]), pa.array([counts[w] for w in sorted(counts)], pa.int64())], ["word", "n"])
    rows = mapped(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in rows.collect()}


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> tuple[list[int], list[str]]:
    """Starts of the phrases among the words, and the labels that they bring."""
    starts, labels = [], []
    present = set(words)
    for phrase, label in phrases:
        if not present.issuperset(phrase):
            continue
        at = -1
        for _ in range(words.count(phrase[0])):
            at = words.index(phrase[0], at + 1)
            if words[at:at + len(phrase)] == phrase:
                starts.append(at)
                labels.append(label)
    return starts, labels


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base (places of phrases), first_word
    and last_word (their smallest and largest start, else null), base_labels, labels
    (with those of the templates met), score (the largest containment of a template
    that a block meets, else 0) and blocks (line, label and containment of every
    block that meets one, as JSON).

    Null and empty texts have no words and no labels. Phrases run across lines,
    blocks don't. Repeated rows are scanned alike; other columns are ignored. Two
    narrow passes over whole texts."""
    templates = TEMPLATES if templates is None else templates
    side = Templates(templates, frequencies(docs, templates))

    def find(text: bytes, words: list[bytes]) -> list[tuple]:
        if side.index.keys().isdisjoint(words):
            return []
        return [(number, label, share) for number, line in enumerate(text.translate(_LINES).split(b"\n")) for label, share in sorted(side.meets(line.split()).items())]
    return _labelled(docs, PHRASES if phrases is None else phrases, find, lambda words, starts: {label for _, label in starts})


def identified(docs: DataFrame, known: list[Clause] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """The columns of ``scanned`` from windows of words and the clauses of licenses;
    blocks has the first and last word, label and containment of the best window of
    every clause met.

    "General public license" after lesser, library or affero brings the label of that
    license beside the phrase's own. Two narrow passes.

    Null and empty texts have no words and no labels; repeated rows and null ids are
    rows like any other; columns other than doc_id and text are ignored; an empty
    table gives no rows."""
    known = clauses() if known is None else known
    matcher = Matcher(known, frequencies(docs, {str(i): b" ".join(c.words).decode() for i, c in enumerate(known)}))
    gpl = (b"general", b"public", b"license")

    def told(words: list[bytes], starts: list[tuple[int, str]]) -> set[str]:
        return {label for _, label in starts} | {KINDS[words[at - 1]] for at, _ in starts if at and tuple(words[at:at + 3]) == gpl and words[at - 1] in KINDS}
    return _labelled(docs, PHRASES if phrases is None else phrases, lambda text, words: matcher.meets(words), told)


def _labelled(docs: DataFrame, phrases: dict[str, str], find: Callable[[bytes, list[bytes]], list[tuple]], told: Callable[[list[bytes], list[tuple[int, str]]], set[str]]) -> DataFrame:
    """The scan's columns from the blocks that ``find`` gives and the labels that
    ``told`` takes from the places of phrases."""
    known = [(p.split(), label) for p, label in ((p.encode(), v) for p, v in sorted(phrases.items()))]

    def scan(text: bytes | None) -> tuple:
        words = (text or b"").translate(_WORDS).split()
        starts, base = phrase_places(words, known)
        found = find(text or b"", words)
        labels = sorted({*told(words, list(zip(starts, base, strict=True))), *(block[-2] for block in found)})
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(set(base))), ",".join(labels),
                float(np.max([block[-1] for block in found], initial=0.0)), json.dumps(found))

    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def make():
        def step(texts: list[bytes | None]) -> list:
            rows = [scan(t) for t in texts]
            return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return step
    shape = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string"
    return per_text(docs, shape, names, make)
