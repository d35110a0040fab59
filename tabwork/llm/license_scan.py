"""License scan by patience alignment of text with license templates.

A place in a text is looked at when a window of twice a template's length holds
enough of the template's words to reach the coverage at all. There the text and
the template are aligned: words that occur once in both are anchors, the longest
increasing run of anchors is kept, and the gaps between anchors are aligned the
same way. Coverage is the share of the template's words that found a partner.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from tabwork.llm import blocks as B
from tabwork.llm.fm_index import BREAKS, LOWER

PERCENT = 80
# fixed values: public license notices
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

FOUND = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
]))
ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, whose second number rises."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back[i] = piles[at - 1] if at else -1
        tops[at : at + 1] = [y]
        piles[at : at + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two word sequences, rising in both."""
    out: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            open_ += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


class Template:
    def __init__(self, name: str, words: list[int], percent: int):
        self.name, self.words = name, words
        self.counts = Counter(words)
        self.known = np.unique(np.array(words, np.uint64))
        self.least = max(1, -(-percent * len(words) // 100))

    def find(self, words: np.ndarray, places: np.ndarray) -> list[tuple[str, float, int, int]]:
        """Occurrences in one document; places: where words of any template stand."""
        at = np.minimum(np.searchsorted(self.known, words[places]), len(self.known) - 1)
        own = places[self.known[at] == words[places]]
        reach = 2 * len(self.words)
        enough = np.searchsorted(own, own + reach) - np.arange(len(own)) >= self.least
        out, free = [], 0
        for start in own[enough].tolist():
            if start < free:
                continue
            text = words[start : start + reach].tolist()
            if sum((Counter(w for w in text if w in self.counts) & self.counts).values()) < self.least:
                continue
            pairs = patience(text, self.words)
            if len(pairs) >= self.least:
                first, free = start + pairs[0][0], start + pairs[-1][0] + 1
                out.append((self.name, len(pairs) / len(self.words), first, free))
        return out


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = B.utf8(texts)
    for lo, hi in B.ranges(offsets):
        part, edges = LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, word_edges = B.word_spans(part, edges, BREAKS)
        yield lo, B.word_hashes(part, starts, ends), word_edges


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """docs with `licenses`: array of (license, coverage, start, end), start and end in words.

    Words are runs of letters, digits and characters outside ASCII, lower-cased.
    An occurrence covers at least `percent` of the template's words; occurrences of
    one template do not overlap. Null and empty texts have none. All rows and
    columns stay, repeated ones too; a column `licenses` is replaced.
    """
    plain = docs.drop("licenses")
    B.narrow_batches(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.array(list(templates.values()), pa.string())
        ready = [
            Template(name, words[a:b].tolist(), percent)
            for _, words, edges in _words(texts) for name, a, b in zip(templates, edges[:-1], edges[1:], strict=True) if b > a
        ]
        known = np.unique(np.concatenate([t.known for t in ready])) if ready else np.zeros(0, np.uint64)
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lo, words, edges in _words(pc.fill_null(batch["text"], "")) if len(known) else ():
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                places = np.flatnonzero(known[at] == words)
                cut = np.searchsorted(places, edges)
                for i in np.flatnonzero(np.diff(cut) >= min(t.least for t in ready)).tolist():
                    own = words[edges[i] : edges[i + 1]]
                    here = places[cut[i] : cut[i + 1]] - edges[i]
                    spans = sorted((s for t in ready for s in t.find(own, here)), key=lambda s: (s[2], s[0]))
                    found[lo + i] = [dict(zip(("license", "coverage", "start", "end"), s, strict=True)) for s in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, ARROW)], names=[*batch.schema.names, "licenses"])

    return plain.mapInArrow(B.lean_batches(scan), T.StructType([*plain.schema.fields, T.StructField("licenses", FOUND)]))
