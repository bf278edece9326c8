"""Licence scans: Dice coefficient of word bigrams against licence templates.

Text and templates are normalised to their words (lower-cased runs of letters
and numbers).  A window is a run of words anywhere in a text, across lines or
within one; its likeness to a template is 2 |A & B| / (|A| + |B|) over their
sets of word bigrams.  Size bounds prune: with L bigrams in the template
(repeats counted) windows have L * THRESHOLD / (2 - THRESHOLD) to
L * (2 - THRESHOLD) / THRESHOLD of them (``widths``: every size, or ``WIDTHS``
evenly spaced ones and L itself where there are more); and as a window that is
alike enough shares THRESHOLD * |B| / (2 - THRESHOLD) distinct bigrams, templates
of which a text has fewer, and places with fewer hits within the widest window,
are not compared.  Templates of under ``LEAST`` bigrams are only compared with
windows of L bigrams or more.

Windows begin with a bigram of the template.  Of a template's windows with one
beginning the most alike counts, the narrowest of equals.  Of overlapping
findings the most alike stays, then the larger template, then the earlier
window, then the narrower, then the template's name.

The sizes of A and A & B of all windows of one size come from one running sum (a
place counts in the windows that hold it, but not its bigram's previous place), so
the work is linear in the text, however often it repeats a notice.

Defined results: null and empty texts have no findings; a template with one
word can't be found; repeated rows are judged one by one; ties follow the order
above; extra columns are ignored, whatever their names; an empty table has no
rows; very long texts are read whole, with memory in proportion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.llm.store import lean
from corpuswright.llm.words import Words, mix, pieces

THRESHOLD = 0.8
#: Sizes of windows tried for a template, at most; bigrams from which windows may be smaller than the template.
WIDTHS, LEAST = 24, 4

#: Licence, template. Notices as they are customarily worded, and short licences whole.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    *((f"GPL-{v}.0", f"This work is licensed under the GNU General Public License, version {v}.") for v in (2, 3)),
    *((f"GPL-{v}.0", f"Licensed under the GNU General Public License, version {v}.") for v in (2, 3)),
    *(
        (
            f"GPL-{v}.0-or-later",
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. "
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        )
        for v in (2, 3)
    ),
    *((f"CC-{kind.upper().replace(' ', '-')}-{v}", f"Licensed under CC {kind.upper()} {v}.") for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")),
    *(
        (f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.")
        for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *(
        (
            f"{kind}GPL-{v}-or-later",
            f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version. "
            f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
        )
        for kind, what, name, v in (("L", "library", "Lesser General Public License", "2.1"), ("L", "library", "Lesser General Public License", "3.0"), ("A", "program", "Affero General Public License", "3.0"))
    ),
    *((f"{kind}GPL-{v}", f"Licensed under the GNU {name}, version {v}.") for kind, name, v in (("L", "Lesser General Public License", "2.1"), ("L", "Lesser General Public License", "3.0"), ("A", "Affero General Public License", "3.0"))),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    *(
        (
            f"BSD-{n}-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            f"2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}"
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
            "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        )
        for n, third in ((2, ""), (3, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "))
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
        "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-only", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "BSL-1.0", "CC0-1.0")),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("proprietary", "All rights reserved."),
]


def bigrams(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15 | 1) + h[1:])


def widths(n: int, threshold: float) -> list[int]:
    """Sizes of the windows that a template of n bigrams is compared with."""
    low = n if n < LEAST else math.ceil(n * threshold / (2 - threshold) - 1e-9)
    high = math.floor(n * (2 - threshold) / threshold + 1e-9)
    if high - low < WIDTHS:
        return list(range(low, high + 1))
    return sorted({n, *(low + (high - low) * i // (WIDTHS - 1) for i in range(WIDTHS))})


def window_sizes(previous: np.ndarray, counted: np.ndarray | None, width: int) -> np.ndarray:
    """Distinct grams in the window of ``width`` at each place: a place counts in the windows that hold it but not the one before with its gram. counted: places that count at all."""
    n = len(previous)
    at = np.arange(n) if counted is None else counted
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, np.maximum(previous[at], at - width) + 1, 1)
    np.add.at(turn, at + 1, -1)
    return np.cumsum(turn)[: n - width + 1]


class Templates:
    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        w = Words([t for _, t in templates])
        h, ends = w.hashes(), np.searchsorted(w.doc, np.arange(len(templates) + 1))
        whole = [bigrams(h[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
        self.length = [len(x) for x in whole]
        self.sets = [np.unique(x) for x in whole]
        pairs = sorted((g, i) for i, s in enumerate(self.sets) for g in s.tolist())
        self.gram = np.array([g for g, _ in pairs], np.uint64)
        self.of = np.array([i for _, i in pairs], np.int64)
        self.known = np.zeros(1 << 16, np.bool_)
        self.known[(self.gram >> np.uint64(48)).astype(np.int64)] = True

    def find(self, texts: list[str | None], threshold: float) -> list[tuple[int, int, float, int, int, int, int]]:
        """(text, template, likeness, first line, last line, first word, last word) of every finding."""
        w = Words(texts)
        h = w.hashes()
        if len(h) < 2 or not len(self.gram):
            return []
        g, doc = bigrams(h), w.doc[:-1]
        near = np.flatnonzero(self.known[(g >> np.uint64(48)).astype(np.int64)] & (w.doc[1:] == doc))
        at = np.minimum(np.searchsorted(self.gram, g[near]), len(self.gram) - 1)
        near = near[self.gram[at] == g[near]]
        ends = np.searchsorted(w.doc, np.arange(len(texts) + 1))
        own = np.searchsorted(near, ends)
        text_first_line = np.searchsorted(w.newlines, np.concatenate([[0], w.ends[:-1] + 1]))
        out = []
        for d in np.unique(doc[near]).tolist():
            a, z = int(ends[d]), int(ends[d + 1])
            places = near[own[d] : own[d + 1]]
            distinct = np.unique(g[places])
            lo, hi = np.searchsorted(self.gram, distinct, side="left"), np.searchsorted(self.gram, distinct, side="right")
            shared = np.bincount(np.concatenate([self.of[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]), minlength=len(self.names))
            maybe = [i for i, s in enumerate(self.sets) if len(s) and shared[i] >= threshold * len(s) / (2 - threshold) - 1e-9]
            if not maybe:
                continue
            grams = g[a : z - 1]
            found = [f for i in maybe for f in self._windows(grams, places - a, i, threshold)]
            for i, dice, x, y in self._chosen(found, z - a):
                lines = np.searchsorted(w.newlines, w.at[[a + x, a + y]]) - text_first_line[d]
                out.append((d, i, dice, int(lines[0]), int(lines[1]), x, y))
        return out

    def _windows(self, grams: np.ndarray, places: np.ndarray, i: int, threshold: float) -> list[tuple[int, float, int, int]]:
        """(template, likeness, first word, last word) of the most alike window from each place on. places: of grams that some template has."""
        s, sizes = self.sets[i], widths(self.length[i], threshold)
        at = np.minimum(np.searchsorted(s, grams[places]), len(s) - 1)
        hits = places[s[at] == grams[places]]
        need = math.ceil(threshold * len(s) / (2 - threshold) - 1e-9)
        if len(hits) < need:
            return []
        # A window that is alike enough has so many hits: those places remain, in stretches that are worked off one by one.
        ahead = np.searchsorted(hits, hits + sizes[-1]) - np.arange(len(hits))
        begins = hits[ahead >= need]
        found = []
        for stretch in np.split(begins, np.flatnonzero(np.diff(begins) > sizes[-1]) + 1):
            if not len(stretch):
                continue
            low = int(stretch[0])
            part = grams[low : int(stretch[-1]) + sizes[-1]]
            order = np.argsort(part, kind="stable")
            previous = np.full(len(part), -1)
            again = part[order][1:] == part[order][:-1]
            previous[order[1:][again]] = order[:-1][again]
            inside = hits[np.searchsorted(hits, low) : np.searchsorted(hits, low + len(part))] - low
            best, size = np.zeros(len(stretch)), np.zeros(len(stretch), np.int64)
            for width in sizes:
                if width > len(part):
                    break
                x = stretch - low
                fits = x + width <= len(part)
                x = x[fits]
                common, have = window_sizes(previous, inside, width)[x], window_sizes(previous, None, width)[x]
                dice = 2 * common / (have + len(s))
                better = np.flatnonzero(fits)[dice > best[fits] + 1e-12]
                best[better] = dice[dice > best[fits] + 1e-12]
                size[better] = width
            found += [(i, float(best[k]), int(stretch[k]), int(stretch[k] + size[k])) for k in np.flatnonzero(best >= threshold - 1e-9).tolist()]
        return found

    def _chosen(self, found: list[tuple[int, float, int, int]], n_words: int) -> list[tuple[int, float, int, int]]:
        """Those that no better one overlaps, by place."""
        found.sort(key=lambda f: (-round(f[1], 12), -len(self.sets[f[0]]), f[2], f[3], self.names[f[0]], f[0]))
        taken = np.zeros(n_words, np.bool_)
        kept: list[tuple[int, float, int, int]] = []
        for f in found:
            if not taken[f[2]] and not taken[f[3]] and not taken[f[2] : f[3] + 1].any():
                taken[f[2] : f[3] + 1] = True
                kept.append(f)
        return sorted(kept, key=lambda f: f[2])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, license, template (its number), dice, first_line, last_line, first_word, last_word (from 0) of every finding; templates: (name, text) pairs, such as whole licences read from a folder of the caller's."""
    chosen = TEMPLATES if templates is None else templates
    src = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = src.select(key, F.lit("").alias("license"), F.lit(0).cast("long").alias("template"), F.lit(0.0).alias("dice"), *(F.lit(0).cast("long").alias(c) for c in ("first_line", "last_line", "first_word", "last_word"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(chosen)
        for b in batches:
            for i, _, texts in pieces(b, "__text"):
                found = t.find(texts, threshold)
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(pa.array([i + f[0] for f in found], pa.int64())), pa.array([t.names[f[1]] for f in found], pa.string()), *(pa.array([f[j] for f in found], kind) for j, kind in ((1, pa.int64()), (2, pa.float64()), *((j, pa.int64()) for j in (3, 4, 5, 6))))],
                    names=schema.names,
                )

    return src.mapInArrow(lean(run), schema)


def op9_query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
