"""License scans: exact phrases and fuzzy short notices.

A text is reduced to its words (ASCII letters in lower case, digits, everything from U+0080) with one space between. A
notice that may be found with ``k`` edits (of code points) is split into ``k + 1`` pieces: k edits leave one of them as it
is, so every place of the notice holds a piece of it exactly. One automaton of all pieces reads each text once; where a
piece is found, the words from every place where the notice could begin are matched against it by the ``regex`` library with
its error bound, best match first, to the end of a word. (Its search form allows no insertion before the first character, so
it is asked at each start.) What it verifies are the places. Documents are read one by one where they lie: nothing is shuffled.

Defined results: a null text is an empty one, with no words, no labels (an empty string), a score of 0 and null places;
texts are scanned whole at any length, a notice may cross lines; repeated rows are scanned each for itself; an empty table
gives an empty table; extra columns pass through, columns of the output's names are replaced. Of overlapping places of one
notice the one with fewer edits is reported (ties: the earlier); places of different notices may overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Passed, ship, slices, tidy

# License names and the opening words of notices as their publishers give them.
#: Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices, their labels and the edits they may be found with.
NOTICES = (
    ("gnu general public license", "gpl", 2),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 6),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("licensed under the apache license", "apache", 2),
    ("you may not use this file except in compliance with the license", "apache", 4),
    ("released under the mit license", "mit", 1),
    ("licensed under the mit license", "mit", 1),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 5),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 6),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse", "bsd", 6),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", 5),
    ("mozilla public license", "mpl", 1),
    ("eclipse public license", "epl", 1),
    ("boost software license", "boost", 1),
    ("permission is granted to anyone to use this software for any purpose including commercial applications", "zlib", 6),
    ("this is free and unencumbered software released into the public domain", "unlicense", 4),
    ("creative commons attribution", "cc-by", 1),
    ("creative commons attribution sharealike", "cc-by-sa", 2),
    ("creative commons attribution share alike", "cc-by-sa", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 2),
    ("creative commons attribution non commercial", "cc-by-nc", 2),
    ("cc by sa", "cc-by-sa", 0),
    ("cc by nc", "cc-by-nc", 0),
    ("cc by nd", "cc-by-nd", 0),
    ("the author has waived all copyright and related or neighboring rights", "cc0", 4),
)

#: What is not a word's byte, once ASCII capitals are small, becomes a space.
_SPACED = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Matched surroundings a worker remembers, and the longest of them that it does.
CACHE_ENTRIES, CACHE_CHARS = 50_000, 400

SPANS = "array<struct<label string, notice string, start long, end long, edits int>>"
MADE = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def normal_words(text: str) -> tuple[bytes, str]:
    """A text's bytes with all but words blanked (as long as the text's own bytes), and its words with one space between."""
    blanked = text.encode().lower().translate(_SPACED)
    return blanked, b" ".join(blanked.split()).decode()


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of a notice, of nearly one length, with their places in it."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Place:
    """A place of a notice among the normal words: code points ``start`` to ``end``."""

    notice: int
    start: int
    end: int
    edits: int


class Scanner:
    """Finds phrases and notices in normal words."""

    def __init__(self, phrases: dict[str, str], notices: tuple[tuple[str, str, int], ...]):
        import ahocorasick
        import regex

        for text, *_ in [*phrases.items(), *notices]:
            if not text or normal_words(text)[1] != text:
                raise ValueError(f"not in normal words: {text!r}")
        for text, _, edits in notices:
            if not 0 <= edits < len(text):
                raise ValueError(f"{edits} edits are not fewer than the {len(text)} code points of {text!r}")
        self.phrases, self.notices = list(phrases.items()), list(notices)
        self.patterns = [regex.compile(rf"(?b)(?:{re.escape(t)}){{e<={k}}}(?![^ ])").match for t, _, k in notices]
        self.cache: dict[tuple[int, str], tuple[int, int] | None] = {}
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _) in enumerate(self.phrases):
            seeds.setdefault(text, []).append((-1 - k, 0))
        for k, (text, _, edits) in enumerate(self.notices):
            for at, piece in pieces(text, edits):
                seeds.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if seeds:
            self.automaton.make_automaton()
        self.any = bool(seeds)

    def _verified(self, k: int, words: str) -> tuple[int, int] | None:
        """End and edits of notice ``k`` at the start of a piece of normal words."""
        key = (k, words)
        if key not in self.cache:
            m = self.patterns[k](words)
            found = m and (m.end(), sum(m.fuzzy_counts))
            if len(words) > CACHE_CHARS:
                return found
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[key] = found
        return self.cache[key]

    def scan(self, words: str) -> tuple[list[tuple[int, int]], list[Place]]:
        """Places of phrases, as phrase and start, and of notices."""
        base: list[tuple[int, int]] = []
        around: dict[int, set[tuple[int, int]]] = {}
        for last, (length, uses) in self.automaton.iter(words) if self.any else ():
            start = last + 1 - length
            for k, at in uses:
                if k < 0:
                    if (start == 0 or words[start - 1] == " ") and (last + 1 == len(words) or words[last + 1] == " "):
                        base.append((-1 - k, start))
                    continue
                text, _, edits = self.notices[k]
                low, high = start - at - edits, start - at + edits
                begin = 0 if low <= 0 else words.find(" ", low - 1, high) + 1  # words that begin from low to high
                while begin or low <= 0:
                    around.setdefault(k, set()).add(begin)
                    low, begin = begin + 1, words.find(" ", begin, high) + 1
        places: list[Place] = []
        for k, begins in around.items():
            text, _, edits = self.notices[k]
            found = []
            for a in begins:
                high = min(len(words), a + len(text) + edits)
                if high < len(words) and words[high] != " ":  # to the last word that ends there
                    high = max(a, words.rfind(" ", a, high))
                if m := self._verified(k, words[a:high]):
                    found.append((a, a + m[0], m[1]))
            taken: list[Place] = []
            # Places of one notice are short and of bounded length, so only neighbours in order can overlap.
            for group in _touching(sorted(found)):
                for e, a, b in sorted((e, a, b) for a, b, e in group):
                    if all(b <= p.start or a >= p.end for p in taken[-len(group) :]):
                        taken.append(Place(k, a, b, e))
            places += taken
        return base, sorted(places, key=lambda p: (p.start, p.end, p.notice))

    def result(self, text: str) -> tuple:
        """The values of ``MADE`` for a text."""
        blanked, words = normal_words(text)
        n_words = words.count(" ") + 1 if words else 0
        base, places = self.scan(words)
        base_labels = {self.phrases[k][1] for k, _ in base}
        labels = base_labels | {self.notices[p.notice][1] for p in places}
        score = max([1.0] * bool(base) + [1 - p.edits / len(self.notices[p.notice][0]) for p in places], default=0.0)
        first = last = None
        if base:
            first, last = words.count(" ", 0, min(s for _, s in base)), words.count(" ", 0, max(s for _, s in base))
        found = [(self.phrases[k][1], self.phrases[k][0], s, s + len(self.phrases[k][0]), 0) for k, s in base]
        found += [(self.notices[p.notice][1], self.notices[p.notice][0], p.start, p.end, p.edits) for p in places]
        spans = _in_text(text, blanked, words, sorted(found, key=lambda x: (x[2], x[3], x[1]))) if found else []
        return n_words, len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans


def _touching(spans: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of spans, in order of their starts, that overlap the run before them."""
    run: list[tuple[int, int, int]] = []
    for s in spans:
        if run and s[0] >= max(b for _, b, _ in run):
            yield run
            run = []
        run.append(s)
    if run:
        yield run


def _in_text(text: str, blanked: bytes, words: str, found: list[tuple]) -> list[dict]:
    """Places among the normal words as places (code points) in the text."""
    on = np.frombuffer(blanked, np.uint8) != 0x20
    edge = np.diff(np.concatenate([[False], on, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not text.isascii():  # bytes to code points
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
        starts, ends = heads[starts], heads[ends]
    blank = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 0x20)
    at = np.searchsorted(blank, [f[2] for f in found])
    to = np.searchsorted(blank, [f[3] for f in found])
    return [
        {"label": label, "notice": notice, "start": int(starts[a]), "end": int(ends[b]), "edits": edits}
        for (label, notice, _, _, edits), a, b in zip(found, at.tolist(), to.tolist(), strict=True)
    ]


_HELD: dict[tuple, Scanner] = {}


def license_scan(
    df: DataFrame, text: str = "text", keep_text: bool = False, phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES
) -> DataFrame:
    """``df`` with ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the exact phrases (number of
    places, smallest and largest word they start at, labels); ``labels`` of phrases and notices; ``score``, the greatest
    share of a found phrase or notice that is not edited (0 if none is found); and ``spans``, all places in the text."""
    ship(df.sparkSession)
    own = Passed(df, MADE, () if keep_text else (text,))
    read = own.frame.select(*own.kept, own[text].cast("string").alias("source"))
    types = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans " + SPANS
    schema = T.StructType([*read.schema[:-1], *T._parse_datatype_string(types).fields])
    span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    made = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    asked = tuple(phrases.items()), tuple(notices)
    Scanner(*_arguments(asked))  # wrong phrases and notices are refused here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if asked not in _HELD:
            _HELD[asked] = Scanner(*_arguments(asked))
        scan = _HELD[asked].result
        for batch in batches:
            last = batch.num_columns - 1
            texts = ["" if t is None else t for t in batch.column(last).to_pylist()]
            for a, b in slices(texts):
                out = zip(*map(scan, texts[a:b]), strict=True)
                cols = [batch.column(k).slice(a, b - a) for k in range(last)]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(v, t) for v, t in zip(out, made, strict=True)]], names=schema.names)

    return read.mapInArrow(tidy(run), schema).select(*own.back, *[F.col(c) for c in MADE])


def _arguments(asked: tuple) -> tuple[dict, tuple]:
    return dict(asked[0]), asked[1]
