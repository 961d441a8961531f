"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters a-z and digits of the lower-cased text; a shingle is five words. For each
template size class B (powers of two up to the longest) a text is cut into half-blocks of B / 2 shingles, and each three
neighbouring half-blocks are a window, so a template of at most B shingles lies whole in some window. Each of ``bands``
bands is one minimum of a permuted hash: a window and a template that share a band's minimum meet. A template of more
than B / 2 shingles that is contained to 0.8 has a Jaccard similarity of over 0.24 with its window, and meets it in one
of 48 bands at least with a probability over 1 - 2e-6 (the smallest class, down to one shingle in a window of six: 0.9998).
A meeting is verified: the share of the template's shingles, as word sequences, that the window holds must be at
least ``least``. A template of fewer than five words is one shingle of its own length, and is found wherever it stands.

Texts are read where they are and nothing is shuffled; minima are hierarchical, so the cost doesn't depend on the number
of templates or classes. The templates are a parameter, pairs or a table (name, text) of at most ``most_templates`` rows; their
index is built in each task.

Defined results: (doc_id, license, containment, first_word) once for each document and template found, with the best
window's containment and the place of the first word of the first such window. A null or empty text has no row; a null
doc_id is kept; rows that repeat a doc_id are scanned one by one; templates without words are refused; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from syncsift.llm.common import arrow, binary_of, only, slices

WORD = re.compile(rb"[a-z0-9]+")
SHINGLE = 5

#: Notices by which public licenses are commonly referred to, the opening of some, and the full text of four.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (
        "MIT-full",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "BSD-3-Clause-full",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC-full",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "Zlib-full",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    ("SPDX-MIT", "SPDX-License-Identifier: MIT"),
    ("SPDX-Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def shingles_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def hashed(words: list[bytes], known: dict[bytes, int], length: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    for w in set(words).difference(known):
        known[w] = digest(w)
    h = np.array([known[w] for w in words], np.uint64)
    n = len(h) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class Scanner:
    def __init__(self, templates, bands: int, least: float, seed: int = 9):
        self.least, self.known = least, {}
        self.odd = np.random.default_rng(seed).integers(1, 1 << 62, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.templates, self.short = [], {}  # short: by length, (hash, name, words) of templates under a shingle
        by_class: dict[int, list[int]] = {}
        for name, text in templates:
            words = words_of(text.encode())
            if not words:
                raise ValueError(f"template {name} has no words")
            if len(words) < SHINGLE:
                self.short.setdefault(len(words), []).append((hashed(words, self.known, len(words))[0], name, words))
                continue
            h = hashed(words, self.known)
            size = max(4, 1 << (len(h) - 1).bit_length())
            by_class.setdefault(size, []).append(len(self.templates))
            self.templates.append((name, shingles_of(words), (h[None, :] * self.odd[:, None]).min(axis=1)))
        self.index = {}
        for size, ids in by_class.items():
            maybe = np.zeros((bands, 1 << 16), bool)
            exact: list[dict[int, list[int]]] = [{} for _ in range(bands)]
            for t in ids:
                for k, m in enumerate(self.templates[t][2].tolist()):
                    maybe[k, m >> 48] = True
                    exact[k].setdefault(m, []).append(t)
            self.index[size] = (maybe, exact)

    def meetings(self, h: np.ndarray, edges: np.ndarray) -> set[tuple[int, int, int]]:
        """(first shingle, last shingle + 1, template) of windows that meet a template. edges: where the texts begin in ``h``, and the end."""
        found = set()
        sizes = sorted(self.index)
        halves = {}
        for size in sizes:  # the half-blocks of each class, within texts
            half = size // 2
            counts = -(-np.diff(edges) // half)
            owner = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            halves[size] = (edges[owner] + place * half, owner)
        for k, odd in enumerate(self.odd):
            x = h * odd
            for size in sizes:
                starts, owner = halves[size]
                if not len(starts):
                    continue
                low = np.minimum.reduceat(x, starts)
                window = low.copy()
                for step in (1, 2):
                    same = owner[step:] == owner[:-step]
                    window[:-step] = np.where(same, np.minimum(window[:-step], low[step:]), window[:-step])
                maybe, exact = self.index[size]
                for w in np.flatnonzero(maybe[k][window >> np.uint64(48)]).tolist():
                    for t in exact[k].get(int(window[w]), ()):
                        end = min(int(starts[w]) + 3 * (size // 2), int(edges[owner[w] + 1]))
                        found.add((int(starts[w]), end, t))
        return found

    def scan(self, texts: list[bytes]) -> list[tuple[int, str, float, int]]:
        """(text, license, containment, first word) of what is verified."""
        if len(self.known) > 1_000_000:
            self.known = {}
        words = [words_of(t) for t in texts]
        brief = []
        for n, templates in self.short.items():
            lead = {t[2][0] for t in templates}
            for i, w in enumerate(words):
                if lead.isdisjoint(w):
                    continue
                h = hashed(w, self.known, n)
                for code, name, wanted in templates:
                    at = next((a for a in np.flatnonzero(h == code).tolist() if w[a : a + n] == wanted), None)
                    if at is not None:
                        brief.append((i, name, 1.0, at))
        hashes = [hashed(w, self.known) for w in words]
        rows = [i for i, h in enumerate(hashes) if len(h)]
        if not rows:
            return sorted(brief)
        edges = np.concatenate([[0], np.cumsum([len(hashes[i]) for i in rows])])
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for a, b, t in self.meetings(np.concatenate([hashes[i] for i in rows]), edges):
            r = int(np.searchsorted(edges, a, side="right")) - 1
            i, at = rows[r], a - int(edges[r])
            name, wanted, _ = self.templates[t]
            share = len(wanted & shingles_of(words[i][at : at + b - a + SHINGLE - 1])) / len(wanted)
            if share >= self.least:
                old = best.get((i, t))
                if old is None or (-share, at) < (-old[0], old[1]):
                    best[i, t] = (share, at)
        return sorted([*brief, *((i, self.templates[t][0], share, at) for (i, t), (share, at) in best.items())])


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] | DataFrame = TEMPLATES, bands: int = 48, least: float = 0.8, most_templates: int = 10_000) -> DataFrame:
    """(doc_id, license, containment, first_word) for each document and template found in it."""
    if isinstance(templates, DataFrame):
        rows = templates.select("name", "text").where("name IS NOT NULL AND text IS NOT NULL").orderBy("name", "text").limit(most_templates + 1).collect()
        if len(rows) > most_templates:
            raise ValueError(f"more than {most_templates} templates")
        templates = tuple((r["name"], r["text"]) for r in rows)

    def run(batches):
        scanner = Scanner(templates, bands, least)
        for batch in slices(batches, "text", 2 << 20):
            raw, at = binary_of(batch.column("text"))
            data, at = raw.tobytes(), at.tolist()
            found = scanner.scan([data[a:b] for a, b in zip(at, at[1:], strict=False)])
            if found:
                i, name, share, first = zip(*found, strict=True)
                kinds = (pa.string(), pa.float64(), pa.int64())
                cols = [batch.column("doc_id").take(pa.array(i)), *(pa.array(c, k) for c, k in zip((name, share, first), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "license", "containment", "first_word"])

    return arrow(run, only(docs, "doc_id", "text"), "doc_id long, license string, containment double, first_word long")


def digest(docs: DataFrame) -> DataFrame:
    return license_scan(docs)
