"""License scan: fuzzy search for short notices.

Texts are reduced to their words (A-Z lower-cased) joined by single spaces. A
notice of which up to k characters may be wrong is cut into k + 1 seeds; by the
pigeonhole principle a place with at most k edits holds one seed unchanged. One
automaton finds all seeds; every hit is verified in a window of its own: runs of whole
words that begin and end within k characters of where the notice would are matched by
the regex library with bounded errors, and the one with the fewest edits is the place.
So a scan's time grows with the number of hits, and no place hides another; of places
of one notice that overlap, the better stays. A notice's words of fewer than
``SHORT`` letters must stand in a place unchanged and in order ("kit license" is no
"mit license"). Base phrases are such notices too; of their places those without an
edit count as base places.

Defined cases: null or empty text has no words, no labels and score 0; repeated
rows are scanned each by itself; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import strings, terms

# The base phrases, and the opening words of common notices, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("mozilla public license", "mpl"),
    ("licensed under cc by", "cc"),
    ("creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("gnu free documentation license", "gfdl"),
    ("eclipse public license", "epl"),
    ("european union public licence", "eupl"),
    ("common development and distribution license", "cddl"),
    ("boost software license", "bsl"),
    ("sil open font license", "ofl"),
    ("redistributions of source code must retain the above copyright notice", "bsd"),
    ("permission to use copy modify and distribute this software for any purpose", "isc"),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
)
CHARS_PER_EDIT = 10
MAX_EDITS = 6
SHORT = 5

SPAN = "struct<label:string,notice:string,first_char:long,last_char:long,first_word:long,edits:int>"


def edits_allowed(phrase: str) -> int:
    return min(MAX_EDITS, len(phrase) // CHARS_PER_EDIT)


def short_words(phrase: str) -> list[str]:
    return [w for w in phrase.split(" ") if len(w) < SHORT]


def _in_order(words: Iterable[str], short: list[str]) -> bool:
    rest = iter(words)
    return all(w in rest for w in short)


@dataclass(frozen=True)
class Match:
    label: str
    notice: str
    start: int
    end: int
    edits: int


def seeds(phrase: str, pieces: int) -> Iterable[tuple[int, str]]:
    cuts = [len(phrase) * i // pieces for i in range(pieces + 1)]
    return [(a, phrase[a:z]) for a, z in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, base: tuple = BASE, notices: tuple = NOTICES):
        self.base = base
        self.all = (*base, *notices)
        self.allowed = [edits_allowed(p) for p, _ in self.all]
        self.patterns = [regex.compile(rf"(?:{regex.escape(p, literal_spaces=True)}){{e<={k}}}", regex.BESTMATCH) for (p, _), k in zip(self.all, self.allowed)]
        self.short = [short_words(p) for p, _ in self.all]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (phrase, _) in enumerate(self.all):
            for at, seed in seeds(phrase, self.allowed[i] + 1):
                places.setdefault(seed, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for seed, owners in places.items():
            self.automaton.add_word(seed, (len(seed), owners))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[list[Match], list[Match]]:
        """Base places (exact, also overlapping ones), and the verified fuzzy matches of all notices, of space-joined words."""
        hits: set[tuple[int, int]] = set()
        exact: set[tuple[int, int]] = set()
        for end, (size, owners) in self.automaton.iter(text):
            for i, at in owners:
                start = end + 1 - size - at
                phrase = self.all[i][0]
                if i < len(self.base) and start >= 0 and text.startswith(phrase, start) and text[start - 1 : start] in ("", " ") and text[start + len(phrase) : start + len(phrase) + 1] in ("", " "):
                    exact.add((start, i))
                hits.add((i, start))
        by_notice: dict[int, set[Match]] = {}
        for i, start in hits:
            if (m := self.verify(text, i, start)) is not None:
                by_notice.setdefault(i, set()).add(m)
        found = [m for own in by_notice.values() for m in _apart(own)]
        base = [Match(self.all[i][1], self.all[i][0], s, s + len(self.all[i][0]), 0) for s, i in sorted(exact)]
        return base, sorted(found, key=lambda m: (m.start, m.end, m.label))

    def verify(self, text: str, i: int, start: int) -> Match | None:
        """The run of whole words around ``start`` that is nearest to notice ``i``, if it is near enough."""
        (phrase, label), k = self.all[i], self.allowed[i]
        end = start + len(phrase)
        if start >= 0 and text.startswith(phrase, start) and text[start - 1 : start] in ("", " ") and text[end : end + 1] in ("", " "):
            return Match(label, phrase, start, end, 0)
        starts = [x for x in range(max(0, start - k), min(len(text), start + k + 1)) if x == 0 or text[x - 1] == " "]
        ends = [x for x in range(max(0, end - k), min(len(text), end + k) + 1) if x == len(text) or text[x] == " "]
        best = None
        for a in starts:
            for z in ends:
                if z <= a or abs(z - a - len(phrase)) > k or not _in_order(text[a:z].split(" "), self.short[i]):
                    continue
                m = self.patterns[i].fullmatch(text, a, z)
                if m is not None and (best is None or (sum(m.fuzzy_counts), a, z) < (best.edits, best.start, best.end)):
                    best = Match(label, phrase, a, z, sum(m.fuzzy_counts))
        return best


def _apart(places: set[Match]) -> list[Match]:
    """Places of one notice without those that overlap a better one (fewer edits, then the earlier)."""
    out: list[Match] = []
    kept = SortedSpans()
    for m in sorted(places, key=lambda m: (m.edits, m.start, m.end)):
        if kept.free(m.start, m.end):
            out.append(m)
    return out


class SortedSpans:
    """Spans that do not overlap; starts in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        """Take the span in if nothing overlaps it."""
        at = bisect_right(self.starts, start)
        if at and self.ends[at - 1] > start or at < len(self.starts) and self.starts[at] < end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


@lru_cache(maxsize=4)
def scanner(base: tuple = BASE, notices: tuple = NOTICES) -> Scanner:
    return Scanner(base, notices)


def _word_numbers(text: str, starts: list[int]) -> list[int]:
    """Word numbers of rising starts, by the spaces between them."""
    out, at, n = [], 0, 0
    for s in starts:
        n += text.count(" ", at, s)
        at = s
        out.append(n)
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans): one row for each row; no shuffle.

    ``spans`` lists every verified place: label, notice, characters in the space-joined words, first word, edits.
    ``score`` is the likeness of the best place: 1 less its share of wrong characters.
    """

    def run(batches):
        own = scanner(base, notices)
        for b in batches:
            rows = []
            for i, raw in zip(b.column(0).to_pylist(), strings(b.column(1))):
                words = terms(raw)
                text = b" ".join(words).decode()
                exact, found = own.scan(text)
                at = _word_numbers(text, [m.start for m in exact])
                every = sorted(set(exact) | set(found), key=lambda m: (m.start, m.end, m.label, m.notice))
                spans = [(m.label, m.notice, m.start, m.end, w, m.edits) for m, w in zip(every, _word_numbers(text, [m.start for m in every]))]
                score = max((1 - m.edits / len(m.notice) for m in every), default=0.0)
                base_labels = ",".join(sorted({m.label for m in exact}))
                labels = ",".join(sorted({m.label for m in every}))
                spans = [dict(zip(("label", "notice", "first_char", "last_char", "first_word", "edits"), s)) for s in spans]
                rows.append((i, len(words), len(exact), at[0] if at else None, at[-1] if at else None, base_labels, labels, score, spans))
            cols = list(zip(*rows)) if rows else [[]] * 9
            span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_char", pa.int64()), ("last_char", pa.int64()), ("first_word", pa.int64()), ("edits", pa.int32())])
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>")
