"""License scan: winnowed fingerprints pick candidate templates, banded alignment reports matched coverage and spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.words import mix, slices, tokenize
from ravelin.runtime import BROADCAST_BYTES, prepare, small_enough, spread

#: Words of a fingerprint, fingerprints of a winnowing window, words by which an alignment may drift.
GRAM, WINDOW, BAND = 3, 2, 6
MIN_COVERAGE = 0.8

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_CLAUSE = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: (license, template): notices, grants and headers, and the whole texts of the short licenses. Longer ones come as a table.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + _CLAUSE),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD}{_CLAUSE} {_AS_IS}"),
]


def grams(words: np.ndarray) -> np.ndarray:
    """Hash of the GRAM words from each position on; the last ones run on into what follows."""
    h = np.zeros(len(words), np.uint64)
    for i in range(GRAM):
        h = mix(h * np.uint64(31) + np.concatenate((words[i:], np.zeros(min(i, len(words)), np.uint64))))
    return h


def winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the least hash of every window of WINDOW, the rightmost at ties."""
    if len(h) <= WINDOW:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.unique(np.arange(len(w)) + WINDOW - 1 - np.argmin(w[:, ::-1], axis=1))


class Index:
    """Inverted index of the winnowed fingerprints of all templates: sorted hashes with (template, position)."""

    def __init__(self, templates: list[tuple[str, str]]):
        w, doc, _, _ = tokenize([t for _, t in templates])
        self.names = [n for n, _ in templates]
        self.words = np.split(w, np.searchsorted(doc, np.arange(1, len(templates))))
        entries = []
        for t, words in enumerate(self.words):
            g = grams(words)[: max(1, len(words) - GRAM + 1)]
            entries += [(int(g[p]), t, int(p)) for p in winnow(g)]
        entries.sort()
        self.hash = np.array([e[0] for e in entries], np.uint64)
        self.template = np.array([e[1] for e in entries], np.int64)
        self.pos = np.array([e[2] for e in entries], np.int64)


def align(text: np.ndarray, template: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(words matched, first, last) of the longest common subsequence of a template and a text that drifts at most BAND from a shift; first and last are text positions, -1 without a match."""
    n, width = len(template), 2 * BAND + 1
    score = [(0, -1, -1)] * (width + 1)
    for i in range(n):
        row = [(0, -1, -1)] * (width + 1)
        for b in range(width):
            j = shift + i + b - BAND
            up, left = score[b + 1], row[b - 1] if b else (0, -1, -1)
            best = up if up[0] >= left[0] else left
            if 0 <= j < len(text) and text[j] == template[i]:
                m, first, _ = score[b]
                if m + 1 > best[0]:
                    best = (m + 1, j if first < 0 else first, j)
            row[b] = best
        score = row
    return max(score, key=lambda s: s[0])


def find(words: np.ndarray, at: np.ndarray, index: Index, min_coverage: float = MIN_COVERAGE) -> list[tuple[int, int, float, int, int]]:
    """(template, matched, coverage, first word, last word) in one text, given the text positions of fingerprints it shares with the
    index. Candidates are bands of diagonals; of overlapping finds the one with most matched words stays."""
    h = grams(words)[at]
    lo, hi = np.searchsorted(index.hash, h, "left"), np.searchsorted(index.hash, h, "right")
    seeds = {(int(index.template[k]), int(p - index.pos[k])) for p, a, b in zip(at, lo, hi) for k in range(a, b)}
    found = []
    last: dict[int, int] = {}
    for t, diagonal in sorted(seeds):
        if t in last and diagonal - last[t] <= BAND // 2:
            continue
        last[t] = diagonal
        tw = index.words[t]
        m, s, e = align(words, tw, diagonal)
        if m / len(tw) >= min_coverage:
            found.append((t, m, m / len(tw), s, e))
    found.sort(key=lambda f: (-f[1], -f[2], f[3], f[0]))
    kept: list[tuple[int, int, float, int, int]] = []
    for f in found:
        if all(f[4] < k[3] or f[3] > k[4] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[3])


def from_table(templates: DataFrame, limit: int = BROADCAST_BYTES) -> list[tuple[str, str]]:
    """Templates of a table (license, text), in order of name and text; null ones are left out, and more bytes of text than limit are an error."""
    t = templates.where("license is not null and text is not null").select("license", "text").distinct()
    if not small_enough(t, "octet_length(text)", limit):
        raise ValueError(f"templates have more than {limit} bytes")
    return sorted((r.license, r.text) for r in t.collect())


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, template, matched_words, coverage, start, end) of every license text found; positions in characters.

    Whole texts are looked at. Null and empty texts give no rows; a null id is kept; repeated rows each give their rows;
    at ties the template listed first counts. Templates without words are ignored. Other columns are ignored, whatever their
    names. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    index = Index([t for t in templates if len(tokenize([t[1]])[0])])
    d = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    names = ["doc_id", "license", "template", "matched_words", "coverage", "start", "end"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(index.hash)
        for b, texts in slices(batches, "_text"):
            w, doc, start, end = tokenize(texts)
            hits = []
            if len(w) and len(known):
                g = grams(w)
                hit = np.flatnonzero(known[np.searchsorted(known, g).clip(max=len(known) - 1)] == g)
                base = np.searchsorted(doc, np.arange(len(texts) + 1))
                ids = b.column("_id").to_pylist()
                for d_ in np.unique(doc[hit]).tolist():
                    a, z = base[d_], base[d_ + 1]
                    own = hit[(hit >= a) & (hit < z)] - a
                    hits += [(ids[d_], index.names[t], t, m, round(c, 4), int(start[a + s]), int(end[a + e])) for t, m, c, s, e in find(w[a:z], own, index, min_coverage)]
            cols = list(zip(*hits)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return spread(d).mapInArrow(rows, "doc_id bigint, license string, template bigint, matched_words bigint, coverage double, start bigint, end bigint")
