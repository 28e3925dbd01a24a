"""License scans: winnowed fingerprints in an inverted index find candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.decontaminate import _FOLD
from sluiceway.llm.textbatch import Words, pieces, texts_of

LEAST_WORDS = 3  # of a template
LEAST_COVERAGE = 0.8
WINDOW = 2  # of winnowing: one word of every two in a row is kept at least

# starts that are aligned together have this many cells in a row of the table
_CELLS = 1 << 20
_STEPS = 32
# an alignment's state in one number: matched words, then the shorter span, then the earlier first word
_BITS = 21
_MOST = (1 << _BITS) - 1

# fixed values: short forms of public licenses and notices
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "mit-line": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "bsd-3-clause-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
}


class Index:
    """Winnowed word fingerprints of the templates, each with the places at which templates have it.

    Fingerprints are of single words, because an alignment may skip words of both sides between any two that
    match. Of every WINDOW words in a row of a template the rarest is kept: the one that fewest
    templates have, of equal ones the one with the least hash. An accepted place misses at most ``missed`` words of
    its template, so it shares at least ``kept - missed`` kept ones, all inside the alignment's band. No accepted
    place lacks them, and a place that lacks them is never aligned.
    """

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        for text in templates.values():
            hashed = Words([text.encode("utf-8").translate(_FOLD)], lower=False).hashes()
            if len(hashed) < LEAST_WORDS:
                raise ValueError(f"a template has at least {LEAST_WORDS} words: {text!r}")
            self.words.append(hashed)
        self.bands = [max(2, len(w) // 5) for w in self.words]
        # the least number of words with the coverage
        self.least = [next(m for m in range(len(w) + 1) if m / len(w) >= LEAST_COVERAGE) for w in self.words]
        having, templates_of = np.unique(np.concatenate([np.unique(w) for w in self.words]), return_counts=True)
        kept = [self._winnowed(w, templates_of[np.searchsorted(having, w)]) for w in self.words]
        # how many kept words an accepted place shares at least
        self.shared = [len(k) - (len(w) - m) for k, w, m in zip(kept, self.words, self.least, strict=True)]
        if min(self.shared) < 1:
            raise ValueError("the window is too long for the coverage")
        # posting lists: the places (template, word) of fingerprint k are at lists[k]:lists[k + 1]
        hashes = np.concatenate([w[k] for w, k in zip(self.words, kept, strict=True)])
        order = np.argsort(hashes, kind="stable")
        self.prints, first = np.unique(hashes[order], return_index=True)
        self.lists = np.append(first, len(hashes))
        self.post_template = np.repeat(np.arange(len(kept)), [len(k) for k in kept])[order]
        self.post_word = np.concatenate(kept)[order]

    @staticmethod
    def _winnowed(words: np.ndarray, templates_of: np.ndarray) -> np.ndarray:
        """The places of the words that are kept."""
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.lexsort((words, templates_of))] = np.arange(len(words))
        windows = np.lib.stride_tricks.sliding_window_view(rank, min(WINDOW, len(words)))
        return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))

    def candidates(self, hashed: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, firsts, lasts): ranges of starts whose band holds enough kept words.

        ``at`` is the place of each word. Places of different texts lie farther apart than any alignment reaches.
        """
        found = np.minimum(np.searchsorted(self.prints, hashed), len(self.prints) - 1)
        hit = np.flatnonzero(self.prints[found] == hashed)
        begin = self.lists[found[hit]]
        many = self.lists[found[hit] + 1] - begin
        posting = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        start = np.repeat(at[hit], many) - self.post_word[posting]
        template = self.post_template[posting]
        order = np.lexsort((start, template))
        edges = np.searchsorted(template[order], np.arange(len(self.words) + 1))
        for number, shared in enumerate(self.shared):
            places = start[order[edges[number] : edges[number + 1]]]
            if len(places) < shared:
                continue
            low, high = places[: len(places) - shared + 1], places[shared - 1 :]
            near = high - low <= 2 * self.bands[number]
            if near.any():
                yield number, high[near] - self.bands[number], low[near] + self.bands[number]

    @property
    def reach(self) -> int:
        """No alignment that begins at a word reads farther than this from it, on either side."""
        return max(len(w) + 2 * b for w, b in zip(self.words, self.bands, strict=True))

    def matches(self, hashed: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(template, coverage, first word, end word) of the accepted places, best first where they overlap."""
        found = set()
        for number, firsts, lasts in self.candidates(hashed, np.arange(len(hashed))):
            # ranges overlap; they ascend, so each adds what lies beyond the ones before
            begins = np.maximum(firsts, np.concatenate(([firsts[0]], np.maximum.accumulate(lasts)[:-1] + 1)))
            many = np.maximum(lasts - begins + 1, 0)
            starts = np.repeat(begins - np.cumsum(many) + many, many) + np.arange(many.sum())
            template, band = self.words[number], self.bands[number]
            # a wide band moves in steps and is wider by one, which holds all alignments between; templates of
            # fewer than 5 * _STEPS words are aligned at every start
            step = 1 + band // _STEPS
            if step > 1:
                starts, band = np.unique(starts // step * step), band + step
            block = max(1, _CELLS // (2 * band + 1))
            for k in range(0, len(starts), block):
                matched, a, b = align(template, hashed, starts[k : k + block], band)
                good = matched >= self.least[number]
                found.update(
                    zip([number] * int(good.sum()), *(x[good].tolist() for x in (matched, a, b)), strict=True)
                )
        taken: list[tuple[int, int, int, int]] = []
        # of equal scores the shortest span, then the first
        for match in sorted(found, key=lambda m: (-m[1], m[3] - m[2], m[2], m[0])):
            if all(match[3] <= t[2] or match[2] >= t[3] for t in taken):
                taken.append(match)
        return [
            (number, score / len(self.words[number]), a, b)
            for number, score, a, b in sorted(taken, key=lambda m: (m[2], m[0]))
        ]


def align(
    template: np.ndarray, text: np.ndarray, starts: np.ndarray, band: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Most template words found in order near each start, and the first and end text word they span.

    A longest common subsequence within ``band`` of the diagonal: word i of the template is
    looked for at start + i - band to start + i + band. Of equal scores the shortest span wins, then the earlier one.
    One row of the table for all starts at a time; within a row the best so far is a running maximum.
    """
    width = 2 * band + 1
    places = (starts - band)[:, None] + np.arange(width)
    # a first word is counted from the start of the band
    base = (starts - band)[:, None]
    nothing = (_MOST << _BITS) | _MOST
    best = np.full(places.shape, nothing, dtype=np.int64)
    for i in range(len(template)):
        at = places + i
        inside = (at >= 0) & (at < len(text))
        equal = inside & (text[np.clip(at, 0, len(text) - 1)] == template[i])
        matched = best >> (2 * _BITS)
        first = np.where(matched == 0, at, _MOST - (best & _MOST) + base)
        more = ((matched + 1) << (2 * _BITS)) | ((_MOST - (at - first)) << _BITS) | (_MOST - (first - base))
        row = np.where(equal, more, 0)
        row[:, :-1] = np.maximum(row[:, :-1], best[:, 1:])
        row[:, -1] = np.maximum(row[:, -1], best[:, -1])
        best = np.maximum.accumulate(row, axis=1)
    last = best[:, -1]
    first = _MOST - (last & _MOST) + base[:, 0]
    return last >> (2 * _BITS), first, first + _MOST - ((last >> _BITS) & _MOST) + 1


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def _scan(templates: tuple[tuple[str, str], ...]):
    schema = pa.schema(
        [
            ("names", pa.list_(pa.string())),
            ("coverage", pa.list_(pa.float64())),
            ("starts", pa.list_(pa.int64())),
            ("stops", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(templates)
        for batch in batches:
            texts = texts_of(batch.column(1))
            rows: list[list[tuple]] = [[] for _ in texts]
            for begin, end in pieces(texts):
                words = Words([t.translate(_FOLD) for t in texts[begin:end]], lower=False)
                hashed = words.hashes()
                counts = np.diff(words.first)
                owner = np.repeat(np.arange(end - begin), counts)
                at = np.arange(len(hashed)) + owner * (3 * index.reach)
                # the first place of each text, less than half the gap before it
                edges = words.first[:-1] + np.arange(end - begin) * (3 * index.reach) - index.reach
                middles = [(a + b) // 2 for _, a, b in index.candidates(hashed, at)]
                near = np.searchsorted(edges, np.concatenate(middles), side="right") - 1 if middles else []
                for k in np.unique(near).tolist():
                    a, b = words.first[k], words.first[k + 1]
                    text, base = texts[begin + k], words.text_start[k]
                    for number, coverage, first, stop in index.matches(hashed[a:b]):
                        span = (words.start[a + first] - base, words.end[a + stop - 1] - base)
                        rows[begin + k].append(
                            (index.names[number], coverage, *(len(text[:x].decode("utf-8")) for x in span))
                        )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(
                        pa.array([[m[c] for m in row] for row in rows], field.type)
                        for c, field in enumerate(schema)
                    ),
                ],
                schema=pa.schema([("doc_id", batch.column(0).type), *schema]),
            )

    return run


def find_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id`` and ``licenses`` for every row.

    ``licenses`` is an array of structs ``license``, ``coverage`` (matched template words over
    template words, at least LEAST_COVERAGE), ``start``, ``stop`` (code points of the matched words, end
    exclusive), in text order. Every place where the alignment reaches that coverage is found. Of overlapping
    matches the one with most matched words stays, of equal ones the shortest.
    Words are as in decontamination. Null and empty texts have none; repeated rows are
    scanned one by one; an empty table gives no rows.
    """
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(
        _scan(tuple((templates or TEMPLATES).items())),
        "doc_id long, names array<string>, coverage array<double>, starts array<long>, stops array<long>",
    )
    return found.select(
        "doc_id",
        F.arrays_zip(
            F.col("names").alias("license"), "coverage",
            F.col("starts").alias("start"), F.col("stops").alias("stop"),
        ).alias("licenses"),
    )
