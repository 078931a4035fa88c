"""License notices, found by MinHash bands over overlapping text windows and verified by shingle containment.

Words are runs of letters and digits, ASCII letters in lower case; shingles are pairs of neighbouring words.
Text is read through windows of three scales (SCALES: words, stride, and the length of the templates sought with
it; a scale without templates costs nothing). Of a template every window is indexed, at stride 1, so a whole occurrence in a text always holds a window
that equals an indexed one, which then collides in every band: recall 1 for exact notices. With BANDS bands of
ROWS samples, a window in which edits leave a Jaccard similarity s collides with probability
1 - (1 - s^ROWS)^BANDS: 0.97 at 0.6, 0.999 at 0.75. A candidate is verified on the words where the template
would lie, with a fifth of its length to either side: at least CONTAINMENT of its shingles have to be there.

The templates are a constant of some kilobytes and travel with the function; documents aren't shuffled.

Defined results: null or empty text has no notices; null doc_id is reported as null; repeated rows each report;
very long texts are scanned whole; a document has a row for every template it holds, with the best containment;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import U, buffers, folded_table, mix, slices, words

SCALES = ((2, 1, 2, 4), (4, 2, 5, 23), (16, 8, 24, 1 << 30))
BANDS, ROWS = 8, 2
CONTAINMENT = 0.8
DENIAL = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
#: Notices as licences ask for them or as authors usually put them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + DENIAL,
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
}


def folded(column, lo: int, hi: int, at, data, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    if "table" not in cache:
        cache["table"] = folded_table()
    row, h, _, _ = words(at, data, lo, hi, cache["table"], cache)
    return row, h


def shingles(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])


def minima(pairs: np.ndarray, width: int, at: np.ndarray, seed: int) -> np.ndarray:
    """The least hash, under a seed, of the width - 1 shingles of the windows that start at at."""
    x = (pairs * U(2 * int(mix(np.array([seed + 1], U))[0] >> U(1)) + 1)) >> U(32)
    size, need = 1, width - 1
    while size * 2 <= need:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[at], x[at + need - size]) if size < need else x[at]


def band_keys(pairs: np.ndarray, width: int, at: np.ndarray):
    for band in range(BANDS):
        key = np.zeros(len(at), U)
        for i in range(ROWS):
            key = key * U(0x9E3779B97F4A7C15) + minima(pairs, width, at, band * ROWS + i)
        yield key ^ (key >> U(29))


class Index:
    """Band keys of the windows of all templates, by scale."""

    def __init__(self, templates: dict[str, str]):
        cache: dict = {}
        self.names, self.scales, self.shingles, self.length = list(templates), [], [], []
        hashes = []
        for text in templates.values():
            at, data = buffers(pa.array([text]))
            h = folded(None, 0, 1, at, data, cache)[1]
            hashes.append(h)
            self.length.append(len(h))
            self.shingles.append(np.unique(shingles(h)))
        for width, stride, least, most in SCALES:
            found: list[list] = [[] for _ in range(BANDS)]
            for t, h in enumerate(hashes):
                if least <= len(h) <= most:
                    at = np.arange(len(h) - width + 1)
                    for band, key in enumerate(band_keys(shingles(h), width, at)):
                        found[band] += [(int(k), t, int(o)) for k, o in zip(key, at)]
            bands = []
            for entries in found:
                entries.sort()
                keys = np.array([e[0] for e in entries], U)
                some = np.zeros(1 << 16, bool)
                some[(keys & U(0xFFFF)).astype(np.int64)] = True
                bands.append((some, keys, np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64)))
            self.scales.append((width, stride, bands))

    def candidates(self, row: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Distinct (template, first word) of places in the words h where a template may lie."""
        out, pairs = [], shingles(h)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        for width, stride, bands in self.scales:
            if len(h) < width or not len(bands[0][1]):
                continue
            at = np.flatnonzero((row[: len(row) - width + 1] == row[width - 1 :]) & (place[: len(row) - width + 1] % stride == 0))
            for (some, keys, template, offset), key in zip(bands, band_keys(pairs, width, at)):
                hit = np.flatnonzero(some[(key & U(0xFFFF)).astype(np.int64)])
                lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                real = hi > lo
                for i, a, b in zip(at[hit[real]].tolist(), lo[real].tolist(), hi[real].tolist()):
                    out += [(int(template[j]), i - int(offset[j]), i) for j in range(a, b)]
        return sorted(set(out))

    def matches(self, row: np.ndarray, h: np.ndarray, threshold: float):
        """(row, template, containment) of verified candidates, the best of each row and template."""
        best: dict = {}
        pairs = shingles(h) if len(h) > 1 else np.zeros(0, U)
        done = set()
        for t, first, inside in self.candidates(row, h):
            r = int(row[inside])
            if (r, t, first) in done:
                continue
            done.add((r, t, first))
            m, own = self.length[t], self.shingles[t]
            slack = max(2, m // 5)
            lo, hi = np.searchsorted(row, r, "left"), np.searchsorted(row, r, "right")
            a, b = max(first - slack, int(lo)), min(first + m + slack, int(hi))
            share = np.isin(own, pairs[a : b - 1], assume_unique=False).sum() / len(own)
            if share >= threshold:
                best[r, t] = max(best.get((r, t), 0.0), float(share))
        return [(r, t, s) for (r, t), s in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = CONTAINMENT) -> DataFrame:
    """doc_id, license and containment for each template that a document holds."""
    templates = TEMPLATES if templates is None else templates
    for name, text in templates.items():
        if len(folded(None, 0, 1, *buffers(pa.array([text])), {})[1]) < 2:
            raise ValueError(f"{name}: a template has two words at least")

    def run(batches):
        index, cache = Index(templates), {}
        for batch in batches:
            at, data = buffers(batch.column(1))
            ids, out = batch.column(0), []
            for lo, hi in slices(at):
                row, h = folded(None, lo, hi, at, data, cache)
                if len(h) > 1:
                    out += [(lo + r, index.names[t], s) for r, t, s in index.matches(row, h, threshold)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.float64())], ["doc_id", "license", "containment"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, license string, containment double")
