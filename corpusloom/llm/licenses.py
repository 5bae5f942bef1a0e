"""Licence scan with a generalised suffix automaton of licence notices.

The automaton accepts every run of consecutive words of every notice.  A text is
streamed through it word by word, which gives for each position the longest run
of words ending there that occurs in some notice (matching statistics).  Runs
that cannot be extended are chained, per notice and in the notice's own order,
into spans; a span that covers enough of its notice gives the notice's label.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.runtime import text_rows, tidy

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices by which a licence is usually announced, and their labels.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
)

#: Words a run needs to join a chain, words between two runs of a chain, and the part of its notice that a span must cover.
MIN_RUN, MAX_GAP, MIN_COVER = 3, 8, 0.8

#: Bytes that separate words become spaces, A-Z become a-z.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """ASCII letters and digits, and whatever is beyond ASCII; A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


class NoticeAutomaton:
    """Suffix automaton of several sequences of word numbers; word number 0 occurs in none."""

    def __init__(self, notices: list[list[bytes]]):
        self.notices = notices
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        ends: list[dict[int, int]] = [{}]
        for n, notice in enumerate(notices):
            last = 0
            for at, w in enumerate(notice):
                last = self._extend(last, self.number.setdefault(w, len(self.number) + 1), ends)
                ends[last].setdefault(n, at)
        # a state's runs end wherever those of the states that link to it end
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            for n, at in ends[state].items():
                if (up := self.link[state]) > 0:
                    ends[up][n] = min(at, ends[up].get(n, at))
        self.ends = ends

    def _extend(self, last: int, word: int, ends: list[dict[int, int]]) -> int:
        if word in self.step[last]:
            follow = self.step[last][word]
            return follow if self.length[follow] == self.length[last] + 1 else self._clone(last, word, follow, ends)
        new = self._state(self.length[last] + 1, {}, ends)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            follow = self.step[at][word]
            self.link[new] = follow if self.length[follow] == self.length[at] + 1 else self._clone(at, word, follow, ends)
        return new

    def _state(self, length: int, step: dict[int, int], ends: list[dict[int, int]]) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(0)
        ends.append({})
        return len(self.step) - 1

    def _clone(self, at: int, word: int, old: int, ends: list[dict[int, int]]) -> int:
        new = self._state(self.length[at] + 1, dict(self.step[old]), ends)
        self.link[new], self.link[old] = self.link[old], new
        while at >= 0 and self.step[at].get(word) == old:
            self.step[at][word] = new
            at = self.link[at]
        return new

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) wherever at least two words match; other positions match one or none."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        known = np.flatnonzero(ids)
        if len(known) < 2:
            return
        breaks = np.flatnonzero(np.diff(known) > 1) + 1
        first, last = known[np.r_[0, breaks]], known[np.r_[breaks - 1, len(known) - 1]]
        step, link, longest = self.step, self.link, self.length
        long_enough = last > first
        for a, b in zip(first[long_enough].tolist(), last[long_enough].tolist(), strict=True):
            state = length = 0
            for at, word in enumerate(ids[a : b + 1].tolist(), a):
                while state and word not in step[state]:
                    state = link[state]
                    length = longest[state]
                state = step[state].get(word, 0)
                length = length + 1 if state else 0
                if length > 1:
                    yield at, state, length


@lru_cache(maxsize=1)
def automaton() -> NoticeAutomaton:
    return NoticeAutomaton([words_of(t) for t, _ in BASE] + [words_of(t) for _, t in NOTICES])


def find_licenses(words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Base places (start, label), and spans (start, end, label, covered part) of notices."""
    auto = automaton()
    by_last: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
    for n, (_, label) in enumerate(BASE):
        by_last[auto.notices[n][-1]].append((auto.notices[n], label))
    places, runs, before = [], [], None
    for at, state, length in auto.statistics(words):
        for phrase, label in by_last.get(words[at], ()):
            if length >= len(phrase) and words[at + 1 - len(phrase) : at + 1] == phrase:
                places.append((at + 1 - len(phrase), label))
        if before and (at != before[0] + 1 or length <= before[2]) and before[2] >= MIN_RUN:
            runs.append(before)
        before = (at, state, length)
    if before and before[2] >= MIN_RUN:
        runs.append(before)
    open_: dict[int, list[int]] = {}
    spans: dict[tuple[int, int, str], float] = {}

    def close(n: int, chain: list[int]) -> None:
        if (part := chain[3] / len(auto.notices[n])) >= MIN_COVER:
            key = (chain[0], chain[1], NOTICES[n - len(BASE)][0])
            spans[key] = max(part, spans.get(key, 0.0))

    for at, state, length in runs:
        start = at + 1 - length
        for n, end in auto.ends[state].items():
            if n < len(BASE):
                continue
            chain = open_.get(n)  # start, last word, last word of the notice, words covered
            if chain and start - chain[1] <= MAX_GAP and end > chain[2]:
                new = min(length, end - chain[2], at - chain[1])
                open_[n] = [chain[0], at, end, chain[3] + new]
            else:
                if chain:
                    close(n, chain)
                open_[n] = [start, at, end, length]
    for n, chain in open_.items():
        close(n, chain)
    return sorted(places), sorted((*k, v) for k, v in spans.items())


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base
    place, null without one.  ``labels`` adds the notices' labels to the base
    ones; ``score`` is the largest part of a phrase or notice that a span covers,
    1 with any base place, 0 without a finding.  ``places`` has all base places
    and spans (start, end: first and last word).  Null and empty texts have no
    words.  Texts of any length are streamed whole.  Repeated rows give repeated
    results, further columns are ignored, an empty table gives an empty one.
    """
    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    width = {label: len(words_of(text)) for text, label in BASE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                places, spans = find_licenses(words)
                base = sorted({label for _, label in places})
                every = sorted({*base, *(x[2] for x in spans)})
                found = sorted([(a, a + width[label] - 1, label) for a, label in places] + [x[:3] for x in spans])
                rows.append((len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(every), 1.0 if places else max((x[3] for x in spans), default=0.0), [{"start": a, "end": b, "label": c} for a, b, c in found]))
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), struct]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols, kinds)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    return text_rows(df, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<start:bigint,end:bigint,label:string>>")
