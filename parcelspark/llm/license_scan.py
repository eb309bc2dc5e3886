"""License scan: exact phrases, and a fuzzy search for short notices.

Texts are reduced to their words (see ``words``), joined by single spaces. Exact
phrases are found there directly. A notice may differ in ``errors`` characters
(insertions, deletions, substitutions): it is cut into ``errors + 1`` parts, of
which any such place keeps at least one unchanged (pigeonhole). One Aho-Corasick
pass finds those parts; around each, in a window of its own, ``regex`` matches the notice with
bounded errors from a word's begin to a word's end. What a window gave is remembered, so that a
text of one seed over and over costs a search per kind of window.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .util import documents, text_buffers
from .words import _LOWER

#: Phrase -> label (fixed values).
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: (notice words, label) that the fuzzy search looks for (fixed values).
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license version 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("all rights reserved", "proprietary"),
]

#: Windows that a task remembers at most.
CACHE = 100_000
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<label:string,start:long,end:long,errors:int>>")
_SPACES = bytes(b or 0x20 for b in _LOWER.tolist())


def normal(raw: bytes) -> bytes:
    """The words of a text, joined by single spaces."""
    return b" ".join(raw.translate(_SPACES).split())


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str]], error_rate: float):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.seeds = ahocorasick.Automaton()
        self.notices = []
        parts: dict[str, list] = {}
        for k, (text, label) in enumerate(notices):
            # latin-1 characters are bytes one to one, for the automaton and the regex alike
            text = text.encode().decode("latin-1")
            errors = int(len(text) * error_rate)
            pattern = regex.compile(rf"(?b)(?:{regex.escape(text)}){{e<={errors}}}")
            self.notices.append((pattern, label, len(text), errors))
            for i in range(errors + 1):
                a, b = len(text) * i // (errors + 1), len(text) * (i + 1) // (errors + 1)
                parts.setdefault(text[a:b], []).append((k, a))
        for seed, uses in parts.items():
            self.seeds.add_word(seed, (len(seed), uses))
        if parts:
            self.seeds.make_automaton()
        self.any = bool(parts)
        self.known: dict[tuple[int, str], list[tuple[int, int, int]]] = {}

    def base(self, norm: bytes) -> list[tuple[int, str]]:
        """(word index, label) of every place of a phrase."""
        found, padded = [], b" " + norm + b" "
        for phrase, label in self.phrases:
            at, last, word = padded.find(phrase), 0, -1
            while at >= 0:
                word += padded.count(b" ", last, at + 1)  # a place's number is that of the blank before it
                last = at + 1
                found.append((word, label))
                at = padded.find(phrase, at + 1)
        return found

    def windows(self, text: str) -> set[tuple[int, int]]:
        """(notice, place where it would begin) of every seed."""
        return {(k, end + 1 - size - offset) for end, (size, uses) in self.seeds.iter(text) for k, offset in uses}

    def matches(self, k: int, window: str) -> list[tuple[int, int, int]]:
        """(start, end, errors) of the notice in a window whose second character is the earliest place where it
        can begin: from every word's begin there to every word's end that the errors leave possible."""
        got = self.known.get((k, window))
        if got is None:
            pattern, _, length, errors = self.notices[k]
            got = []
            for s in range(1, min(len(window), 2 * errors + 2)):
                if window[s - 1] != " " or window[s] == " ":
                    continue
                for t in range(max(s + 1, s + length - errors), min(len(window), s + length + errors + 1)):
                    if window[t] == " " and (m := pattern.fullmatch(window, s, t)):
                        got.append((s, t, sum(m.fuzzy_counts)))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[k, window] = got
        return got

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start character, end character, errors, likeness) of every notice."""
        found, padded = set(), f" {text} "
        for k, at in self.windows(padded) if self.any else ():
            _, label, length, errors = self.notices[k]
            lo = at - errors - 1  # so that the blank before the earliest begin is seen, and that after the last end
            window = padded[max(0, lo):at + length + 2 * errors + 1]
            if lo < 0:
                window = " " * -lo + window
            for s, t, e in self.matches(k, window):
                found.add((e, s - t, lo + s - 1, label, 1 - e / length))
        best: list = []  # where notices overlap, the one with the fewest errors stays, then the longest
        for e, size, start, label, like in sorted(found):
            i = bisect_left(best, (start - size,))  # the spans that begin before this one's end
            if not i or best[i - 1][1] <= start:
                insort(best, (start, start - size, label, e, like))
        return [(label, s, t, e, like) for s, t, label, e, like in best]


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None,
         error_rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, exact phrase places, labels, and the spans of fuzzy notices.

    ``n_base`` counts all places of the phrases, ``first_word``/``last_word`` are
    their smallest and largest start (else null), ``base_labels`` and ``labels``
    (phrases, or phrases and notices) are distinct, sorted and comma-joined (empty
    if none). ``score`` is 1 with an exact phrase, else the likeness of the best
    notice, else 0. ``spans`` are word positions, end exclusive; a notice begins and ends with
    whole words of the text. A null or empty text has no words; null ids and repeated rows are
    kept; an empty table gives an empty result; extra columns are ignored. A very long text is
    scanned whole by its task, in time that grows with its seeds.
    """
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices

    def run(batches):
        scanner = Scanner(phrases, notices, error_rate)
        cols = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
            [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32())]))]
        for batch in batches:
            offsets, raw = text_buffers(batch.column(1))
            out = [[] for _ in cols]
            for i in range(batch.num_rows):
                norm = normal(raw[offsets[i]:offsets[i + 1]].tobytes())
                base = scanner.base(norm)
                own = sorted({label for _, label in base})
                fuzzy = scanner.fuzzy(norm.decode("latin-1"))
                spans, w, last = [], 0, 0
                for label, s, e, errors, _ in fuzzy:
                    w, last = w + norm.count(b" ", last, s), s
                    spans.append({"label": label, "start": w, "end": w + len(norm[s:e].split()), "errors": errors})
                row = (norm.count(b" ") + 1 if norm else 0, len(base), min((w for w, _ in base), default=None),
                       max((w for w, _ in base), default=None), ",".join(own),
                       ",".join(sorted({*own, *(f[0] for f in fuzzy)})),
                       1.0 if base else max((f[4] for f in fuzzy), default=0.0), spans)
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["doc_id", *cols])

    return documents(docs, id_col, text_col).mapInArrow(run, SCHEMA)
