"""License scans: winnowed fingerprints pick candidates, banded alignment confirms.

Words are runs of ASCII letters and digits and of other non-ASCII characters, lower
case.  Templates are cut into shingles of ``K`` words and winnowed over ``W``
shingles into an inverted index, those of fewer than ``SHORT`` words kept whole.  Every
shingle of a text probes it, so a common run of K words of a short template, or of
K + W - 1 words of a longer one, is a hit, whatever words follow.  Hits name a template
and a diagonal; an alignment of the words in a band around it gives matched words,
coverage and the span.  Long templates are aligned where two hits agree.  The numbers of a
template and the words that tell it from others must stand in the span: version 2 is no
version 3, and a lesser license no plain one.  A notice whose
changed words leave no such run is not found.

The index holds the fixed ``TEMPLATES`` only and does not grow with the data.

Defined results: null, empty and license-free texts have no findings; repeated rows
give repeated findings; one finding for each non-overlapping occurrence of a
template, the better covered first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.textbatch import segment_hash, slices, utf8

K, W, BAND, MIN_COVERAGE = 3, 3, 6, 0.8
SHORT, LONG = 12, 30

# License texts and notices.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_GNU_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
_GNU_HEADER = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."


def _gnu(name: str, version: str) -> dict[str, str]:
    short = {"General Public License": "gpl", "Lesser General Public License": "lgpl", "Affero General Public License": "agpl"}[name]
    return {f"{short}-{version}-header": "This program " + _GNU_HEADER.format(name, version.removesuffix(".0")), f"{short}-{version}": f"licensed under the GNU {name}, version {version.removesuffix('.0')}."}


TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-grant": _MIT_GRANT,
    "mit-text": f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}",
    "bsd": _BSD_GRANT,
    "bsd-2-clause-text": f"{_BSD_GRANT}: 1. {_BSD_1} 2. {_BSD_2} {_BSD_WARRANTY}",
    "bsd-3-clause-text": f"{_BSD_GRANT}: 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_BSD_WARRANTY}",
    "isc": _ISC_GRANT,
    "isc-text": f'{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-warranty": "This program " + _GNU_WARRANTY.format("General Public License"),
    **_gnu("General Public License", "3.0"), **_gnu("General Public License", "2.0"), **_gnu("Lesser General Public License", "3.0"), **_gnu("Lesser General Public License", "2.1"), **_gnu("Affero General Public License", "3.0"),
    **{f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in "0BSD AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib".split()},
}

#: Words that tell a license from its relatives: a template that has one is found only with it.
TELLING = {b"lesser", b"affero", b"sharealike", b"nc", b"mit", b"apache", b"mozilla", b"eclipse", b"boost", b"isc", b"unlicense", b"zlib"}

_FOLD = np.arange(256).astype(np.uint8)
_FOLD[65:91] += 32
_IN = np.zeros(256, bool)
_IN[48:58] = _IN[65:91] = _IN[97:123] = _IN[128:] = True
_ODD = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the row limits among them."""
    inside = _IN[data]
    begin, stop = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        cut = off[:-1][off[:-1] < len(data)]
        begin[cut] |= inside[cut]
        last = off[1:][off[1:] > 0] - 1
        stop[last] |= inside[last]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, off)


def _shingles(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of each shingle; none leaves its row."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    at = np.flatnonzero(left >= K)
    return at, segment_hash(h, at, at + K)


def _fingerprints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of each winnowed shingle; a shingle or window never leaves its row."""
    at, g = _shingles(h, first)
    if not len(at):
        return at, g
    row_end = np.repeat(first[1:], np.diff(first))[at] - at - K  # shingles after this one in its row
    best, where = g.copy(), np.arange(len(g))
    for d in range(1, W):
        other = np.minimum(np.arange(len(g)) + d, len(g) - 1)
        less = (row_end >= d) & (g[other] <= best)
        best, where = np.where(less, g[other], best), np.where(less, other, where)
    kept = np.unique(where)
    return at[kept], g[kept]


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names, self.words, self.numbers = list(templates), [], []
        hashes, owner, place = [], [], []
        for i, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), np.uint8)
            s, e, first = _words(data, np.array([0, len(data)]))
            h = segment_hash(_ODD[_FOLD[data]], s, e)
            at, g = (_shingles if len(h) < SHORT else _fingerprints)(h, first)
            self.words.append(h)
            self.numbers.append([w for w, x, y in zip(h.tolist(), s.tolist(), e.tolist(), strict=True) if (raw := text.encode()[x:y].lower()).isdigit() or raw in TELLING])
            hashes.append(g)
            owner += [i] * len(g)
            place += at.tolist()
        g = np.concatenate(hashes)
        order = np.argsort(g, kind="stable")
        self.hash, self.owner, self.place = g[order], np.array(owner)[order], np.array(place)[order]

    def align(self, text: np.ndarray, template: np.ndarray, at: int) -> tuple[int, int, int]:
        """Most words in common order within BAND of the diagonal `at`: count, first and last text word.

        Cell (i, d) stands for template words up to i and text words up to i + at + d - BAND.
        """
        words, n, wide = text.tolist(), len(text), 2 * BAND + 1
        none = (0, 0, -1)
        row = [none] * (wide + 1)  # the last cell is outside the band
        for i, w in enumerate(template.tolist()):
            left, below = none, row
            row = [none] * (wide + 1)
            for d in range(wide):
                j = i + at + d - BAND
                best = max(below[d + 1], left)  # without this template word, or without this text word
                if 0 <= j < n and words[j] == w:
                    count, start, _ = below[d]
                    best = max(best, (count + 1, start if count else -j, j))
                row[d] = left = best
        n, start, end = max(row)
        return n, -start, end

    def _versioned(self, t: int, text: np.ndarray) -> bool:
        """Whether the numbers and telling words of template t stand in the text, in order."""
        rest = iter(text.tolist())
        return all(w in rest for w in self.numbers[t])

    def findings(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, str, int, int, int, int]]:
        """(row, template, matched words, template words, byte start, byte end) of all confirmed hits."""
        s, e, first = _words(data, off)
        h = segment_hash(_ODD[_FOLD[data]], s, e)
        at, g = _shingles(h, first)
        lo, hi = np.searchsorted(self.hash, g), np.searchsorted(self.hash, g, "right")
        out = []
        hit = np.flatnonzero(hi > lo)
        found: dict[tuple[int, int], list[int]] = {}
        for x in hit.tolist():
            word = int(at[x])
            row = int(np.searchsorted(first, word, "right") - 1)
            for y in range(int(lo[x]), int(hi[x])):
                found.setdefault((row, int(self.owner[y])), []).append(word - int(self.place[y]) - int(first[row]))
        for (row, t), diagonals in found.items():
            own, words = h[first[row] : first[row + 1]], self.words[t]
            near = np.array(sorted(set(diagonals) if len(words) < LONG else diagonals))
            if len(words) >= LONG:  # two hits within the band
                pair = np.diff(near) <= BAND
                near = np.unique(near[np.concatenate((pair, [False])) | np.concatenate(([False], pair))])
            done = None
            for diagonal in near.tolist():
                if done is not None and diagonal - done <= BAND // 2:  # the band of the last one holds it
                    continue
                n, a, b = self.align(own, words, diagonal)
                if n >= MIN_COVERAGE * len(words) and self._versioned(t, own[a : b + 1]):
                    out.append((row, t, n, a, b))
                    done = diagonal
        chosen, used = [], {}
        for row, t, n, a, b in sorted(out, key=lambda f: (f[0], f[1], -f[2], f[4] - f[3], f[3])):
            spans = used.setdefault((row, t), [])
            if all(b < c or a > d for c, d in spans):
                spans.append((a, b))
                chosen.append((row, self.names[t], n, len(self.words[t]), int(s[first[row] + a]), int(e[first[row] + b])))
        return sorted(chosen, key=lambda f: (f[0], f[4], f[1]))


_index: dict[int, Index] = {}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each finding: key, license, coverage, n_matched, start and end (code points)."""
    templates = templates or TEMPLATES
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hash(tuple(templates.items()))
        index = _index.setdefault(mark, None) or Index(templates)
        _index[mark] = index
        for batch in batches:
            for part in slices(batch, "t"):
                data, off = utf8(part.column(1))
                found = index.findings(data, off)
                if not found:
                    continue
                rows = [f[0] for f in found]
                points = lambda row, upto: len(data[off[row] : upto].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array([f[1] for f in found]), pa.array([round(f[2] / f[3], 6) for f in found]), pa.array([f[2] for f in found], pa.int64()), pa.array([points(f[0], f[4]) for f in found], pa.int64()), pa.array([points(f[0], f[5]) for f in found], pa.int64())],
                    [key, "license", "coverage", "n_matched", "start", "end"],
                )

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"{key} {key_type}, license string, coverage double, n_matched long, start long, end long")


