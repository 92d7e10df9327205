"""Licences in texts by patience alignment: words unique to both sides are anchors, their longest increasing run is kept,
and the gaps between anchors are aligned the same way, down to gaps without anchors, where equal ends are matched.

Coverage is the share of a template's words that the alignment matches. Texts are aligned in windows of twice the
template's length, one length apart, so that words stay unique however long a text is; a window is looked at only if enough
of the template's words stand in it for the coverage asked for, which no alignment can exceed.

* Null and empty texts have no rows. A text that holds a template several times has a row for each place. Repeated rows are
  scanned each for itself; an empty table gives an empty result. Of other columns nothing is returned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adwatch.llm.decontaminate import bare_words, tokens

MIN_COVERAGE = 0.8
#: Notices by licence, short lines and the opening of longer texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Reserved": ("All rights reserved.",),
}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first number, whose second numbers increase."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(piles[k - 1] if k else -1)
        tops[k:k + 1], piles[k:k + 1] = [b], [i]
    run, i = [], piles[-1] if piles else -1
    while i >= 0:
        run.append(pairs[i])
        i = back[i]
    return run[::-1]


def align(one: list, two: list) -> list[tuple[int, int]]:
    """Places of matched words in both lists, increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(one), 0, len(two))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and one[a] == two[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == two[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(one[a:b]), Counter(two[c:d])
        place = {w: j for j, w in enumerate(two[c:d], c) if right[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(one[a:b], a) if left[w] == 1 and w in place])
        if not anchors:
            continue
        found += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(found)


def scan_words(words: list[str], template: list[str], coverage: float) -> list[tuple[int, int, int]]:
    """Places of a template in a text: first word, word after the last, words matched; they do not overlap."""
    size, need = len(template), -(-int(coverage * 1000) * len(template) // 1000)
    own = Counter(template)
    found: list[tuple[int, int, int]] = []
    for a in range(0, max(1, len(words) - size + 1), max(1, size)):
        part = words[a:a + 2 * size]
        if sum(min(n, own[w]) for w, n in Counter(w for w in part if w in own).items()) < need:
            continue
        matched = align(part, template)
        if len(matched) < need:
            # words of an earlier or later copy can hide the anchors: once more from the first word on that fits
            starts = [i for i, w in enumerate(part) if w == template[0]]
            matched = max((align(part[i:i + size + size // 4 + 1], template) for i in starts), key=len, default=[])
            shift = next((i for i in starts if len(align(part[i:i + size + size // 4 + 1], template)) == len(matched)), 0)
            matched = [(i + shift, j) for i, j in matched]
        if len(matched) >= need:
            found.append((a + matched[0][0], a + matched[-1][0] + 1, len(matched)))
    best: list[tuple[int, int, int]] = []
    for place in sorted(found, key=lambda p: (-p[2], p[1] - p[0], p[0])):
        if all(place[1] <= p[0] or p[1] <= place[0] for p in best):
            best.append(place)
    return sorted(best)


def scan(df: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, coverage: float = MIN_COVERAGE,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per place of a licence: doc_id, license, template (its number), coverage, first_word, end_word (exclusive)."""
    prepared = [(name, k, bare_words(t)) for name, own in templates.items() for k, t in enumerate(own)]
    prepared = [p for p in prepared if p[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends, words, _ = tokens(batch.column(1))
            code_of, rows = {w: i for i, w in enumerate(words)}, []
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            for name, k, template in prepared:
                wanted = Counter(template)
                member = np.zeros(len(words) + 1, np.int64)
                for w, n in wanted.items():
                    if w in code_of:
                        member[code_of[w]] = n
                need = -(-int(coverage * 1000) * len(template) // 1000)
                if member.sum() < need:
                    continue
                at = np.flatnonzero(member[codes])
                pair, times = np.unique(owner[at] * len(words) + codes[at], return_counts=True)
                held = np.bincount(pair // len(words), np.minimum(times, member[pair % len(words)]), len(ends) - 1)
                for d in np.flatnonzero(held >= need).tolist():
                    text_words = [words[c] for c in codes[ends[d]:ends[d + 1]].tolist()]
                    for a, b, n in scan_words(text_words, template, coverage):
                        rows.append((batch.column(0)[d].as_py(), name, k, n / len(template), a, b))
            if rows:
                types = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["doc_id", "license", "template", "coverage", "first_word", "end_word"])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, template int, coverage double, first_word long, end_word long")
