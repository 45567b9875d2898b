"""License scans by patience alignment with license notices.

A text's words are aligned with a notice's: words that occur once in both are
anchors, their longest increasing subsequence is kept, and the gaps between
anchors are aligned in the same way, down to common beginnings and ends. The
share of the notice's words that find a place is its coverage.

Where to align is found first, over the whole text: a place needs at least
``least`` of the notice's words, each as often as the notice has it, within
``spread`` times its length (half of that for notices below SHORT words, whose
words come together by chance), so that insertions up to twice a notice's
length are bridged. Places that need not be aligned can't reach the coverage
asked for. Of overlapping finds the one with more aligned words stands.

Defined cases: null and empty texts hold no license; a very long text is read
whole, in time that grows with the places that may hold a notice; null or repeated doc_ids
and equal rows are scanned like any other; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, flat, prefix_hash, slices, span_hash, spans
from .shared import raw, table

# The wording of common license notices.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("cc0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
SHORT = 20
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = spans(WORD[data], offsets)
    return span_hash(prefix_hash(LOWER[data]), starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by piles."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back[i] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = v, i
    out, at = [], top_at[-1] if top_at else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(text: list[int], notice: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both, by patience."""
    pairs: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(notice))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == notice[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            pairs.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(notice[c:d])
        place = {notice[j]: j for j in range(c, d) if there[notice[j]] == 1}
        common = [(i, place[text[i]]) for i in range(a, b) if here[text[i]] == 1 and text[i] in place]
        anchors = [common[k] for k in _increasing([j for _, j in common])]
        if not anchors:
            continue
        pairs += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            work.append((i + 1, k, j + 1, m))
    return sorted(pairs)


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...], least: float, spread: float = 3.0):
        self.least, self.spread, self.names = least, spread, [n for n, _ in notices]
        hashes, owner = _words(*flat(pa.array([t.encode() for _, t in notices], pa.binary())))
        self.notices = [hashes[owner == k] for k in range(len(notices))]
        self.known = np.unique(hashes)
        self.kinds = [np.unique(n) for n in self.notices]
        self.holds = np.stack([np.isin(self.known, k) for k in self.kinds], axis=1)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple]]:
        """By text: (license, coverage, first word, last word) of what it holds, in order of place."""
        hashes, owner = _words(data, offsets)
        n = len(offsets) - 1
        bounds = np.searchsorted(owner, np.arange(n + 1))
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == hashes)
        present = np.zeros((n, len(self.known)), np.float32)
        present[owner[hit], at[hit]] = 1
        # Words missing from a text are missing from any alignment, at least once each.
        missing = np.array([len(k) for k in self.kinds]) - present @ self.holds
        may = missing <= np.array([len(x) - math.ceil(self.least * len(x)) for x in self.notices])
        out: list[list[tuple]] = [[] for _ in range(n)]
        for text in np.flatnonzero(may.any(axis=1)).tolist():
            words = hashes[bounds[text] : bounds[text + 1]]
            found = [f for k in np.flatnonzero(may[text]).tolist() for f in self._places(words, k)]
            out[text] = self._apart(found)
        return out

    def _places(self, words: np.ndarray, k: int) -> Iterator[tuple]:
        notice = self.notices[k]
        size = len(notice)
        need, width = math.ceil(self.least * size), int(size * (self.spread if size >= SHORT else self.spread / 2)) + 2
        at = np.flatnonzero(np.isin(words, self.kinds[k]))
        begins = at[np.searchsorted(at, at + width) - np.arange(len(at)) >= need]
        # No alignment pairs more of a word than the notice has, or than the place has.
        most = np.zeros(len(begins), np.int64)
        for kind, times in zip(*np.unique(notice, return_counts=True), strict=True):
            mine = at[words[at] == kind]
            most += np.minimum(times, np.searchsorted(mine, begins + width) - np.searchsorted(mine, begins))
        free = 0
        own = notice.tolist()
        for start in begins[most >= need].tolist():
            if start < free:
                continue
            pairs = align(words[start : start + width].tolist(), own)
            if len(pairs) >= need:
                first, last = start + pairs[0][0], start + pairs[-1][0]
                yield len(pairs), len(pairs) / size, first, last, self.names[k]
                free = last + 1

    @staticmethod
    def _apart(found: list[tuple]) -> list[tuple]:
        taken: list[tuple] = []
        for pairs, share, first, last, name in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
            if all(last < a or first > b for _, _, a, b in taken):
                taken.append((name, share, first, last))
        return sorted(taken, key=lambda f: f[2])


FOUND = "array<struct<license:string,coverage:double,first_word:long,last_word:long>>"
FOUND_ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, least: float = 0.85, spread: float = 3.0) -> DataFrame:
    """doc_id and the licenses found, with coverage and place (numbers of words), for every document."""
    scanner = Scanner(notices, least, spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [[dict(zip(("license", "coverage", "first_word", "last_word"), f, strict=True)) for f in found] for found in scanner.scan(*flat(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, FOUND_ARROW)], ["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(run, f"doc_id {kind}, found {FOUND}")


def op8_licenses(spark, sf_dir):
    found = F.col("found")
    best = F.array_max(F.transform(found, lambda f: F.struct(f.coverage, (f.last_word - f.first_word).alias("n"), f.license)))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size(found).alias("n_licenses"), best.license.alias("license"), F.coalesce(best.coverage, F.lit(0.0)).alias("coverage"),
        F.transform(found, lambda f: f.license).alias("licenses"),
    )
