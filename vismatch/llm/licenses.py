"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words: A-Z lower-cased, runs of ASCII digits, letters and non-ASCII characters. A template's set are its shingles of
``SHINGLE`` words. It matches a text if some region of the text, of at most ``ROOM`` times the template's words, holds at
least ``CONTAINED`` of that set; the report gives the best region's containment.

Retrieval: a template is looked for in windows of twice the shingles that its region may have, at every half window, so
that some window holds any region that matches. A window's signature are ``PERMUTATIONS`` minima of permuted shingle
hashes; each is a band of one row, so a window and a template of Jaccard similarity s meet with probability
1 - (1 - s)**PERMUTATIONS. A match has s >= 0.25 (0.29 from 12 words on), hence is retrieved with probability 0.9999 at
least. Minima of all window sizes come from one doubling pass over the shingles of a few hundred texts at once.

The templates are a parameter of fixed, small size; they go to the tasks with the code. Nothing is shuffled.

Defined cases: null and empty texts match nothing; texts of fewer words than a shingle match nothing; a template that
occurs several times gives one row, at its best and first region; repeated rows each get their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM_TABLE, Rolling, WordHash, as_bytes, blocks, mix

SHINGLE = 5
CONTAINED = 0.8
ROOM = 1.25
PERMUTATIONS = 32

# License notices, as their publishers word them.
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "bsd-3-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "boost-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this "
        "entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in "
        "whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object "
        "code generated by a source language processor."
    ),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser "
        "General Public License for more details."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM_TABLE).split()


class Scanner:
    """The templates' sets and bands, and the search for them in texts."""

    def __init__(self, templates: dict[str, str], permutations: int = PERMUTATIONS) -> None:
        self.hashed, self.rolling = WordHash(), Rolling()
        rng = np.random.default_rng(5)
        self.salts = rng.integers(1, 1 << 63, permutations).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.names, self.sets, self.reach = [], [], []
        by_width: dict[int, list[tuple[int, int]]] = {}
        for name, text in sorted(templates.items()):
            words = words_of(text.encode())
            shingles = np.unique(self.shingles(words))
            if not len(shingles):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            reach = int(len(words) * ROOM) - SHINGLE + 1  # shingles of a region
            for p, salt in enumerate(self.salts):
                by_width.setdefault(2 * reach, []).append((int(mix(shingles ^ salt).min() ^ np.uint64(p)), len(self.names)))
            self.names.append(name)
            self.sets.append(shingles)
            self.reach.append(reach)
        self.bands = {w: (np.array([k for k, _ in sorted(own)], np.uint64), np.array([t for _, t in sorted(own)])) for w, own in sorted(by_width.items())}

    def shingles(self, words: list[bytes]) -> np.ndarray:
        return self.rolling.windows(self.rolling.prefix(self.hashed.of(words)), SHINGLE)

    def candidates(self, shingles: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, one past the last) of windows that share a band."""
        found: set[tuple[int, int, int]] = set()
        n = len(shingles)
        for p, salt in enumerate(self.salts):
            low, done = mix(shingles ^ salt), 1  # low[i]: least of the done shingles from i on, or of those that are left
            for width, (keys, of) in self.bands.items():
                while 2 * done <= width and done < n:
                    low[:-done] = np.minimum(low[:-done], low[done:])
                    done *= 2
                at = np.arange(0, n, width // 2)
                values = np.minimum(low[at], low[np.minimum(at + max(0, width - done), n - 1)]) ^ np.uint64(p)
                lo = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                for i in np.flatnonzero(keys[lo] == values).tolist():
                    k, a = int(lo[i]), int(at[i])
                    while k < len(keys) and keys[k] == values[i]:
                        found.add((int(of[k]), a, min(n, a + width)))
                        k += 1
        return found

    def containment(self, shingles: np.ndarray, t: int, first: int, last: int) -> tuple[int, int, int]:
        """Most shingles of template t in a region within reach of [first, last): count, first word, words."""
        reach, own = self.reach[t], self.sets[t]
        a, b = max(0, first - reach), min(len(shingles), last + reach)
        of = np.minimum(np.searchsorted(own, shingles[a:b]), len(own) - 1)
        hits = np.flatnonzero(own[of] == shingles[a:b]).tolist()
        best, left, inside = (0, 0, 0), 0, {}
        for at in hits:
            inside[of[at]] = inside.get(of[at], 0) + 1
            while at - hits[left] >= reach:
                key = of[hits[left]]
                inside[key] -= 1
                if not inside[key]:
                    del inside[key]
                left += 1
            if len(inside) > best[0]:
                best = len(inside), a + hits[left], at - hits[left] + SHINGLE
        return best

    def scan(self, texts: list[bytes | None]) -> list[list[tuple[str, float, int, int]]]:
        """For each text (template, containment, first word, words) of each template that it has."""
        own = [self.shingles(words_of(x)) for x in texts]
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        ends = np.cumsum([len(x) for x in own]) if own else np.zeros(0, np.int64)
        if not len(ends) or not ends[-1]:
            return out
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, a, b in sorted(self.candidates(np.concatenate(own))):  # a window may reach over several texts
            for d in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1):
                before = int(ends[d]) - len(own[d])
                found = self.containment(own[d], t, max(0, a - before), min(len(own[d]), b - before))
                if found[0] >= CONTAINED * len(self.sets[t]) and ((d, t) not in best or (-found[0], found[1]) < (-best[d, t][0], best[d, t][1])):
                    best[d, t] = found
        for (d, t), (n, at, size) in sorted(best.items()):
            out[d].append((self.names[t], n / len(self.sets[t]), at, size))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, start_word, n_words: a row for each template found in each document."""
    known = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for batch in blocks(batches):
            rows = [(doc, *x) for doc, found in zip(batch.column("doc_id").to_pylist(), scanner.scan(as_bytes(batch.column("text")))) for x in found]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "license", "containment", "start_word", "n_words"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, license string, containment double, start_word long, n_words long")
