"""License scans by patience alignment.

Text and template are lists of words. Words that stand once in both are anchors;
the longest run of anchors that is in order in both is kept, and the gaps between
them are aligned the same way, with fewer words to be unique among. The coverage
is the share of the template's words that were aligned.

A place of a template is a span of at most ``stretch`` template lengths that
covers enough of it and holds all that names the license: words in braces in a
template must be aligned, those of one pair of braces side by side, so another
version or variant is no match. Places are looked for in windows of several
sizes, half as large again as the spans of that size, a sixth of a window apart:
a span lies whole in one of them, and in a window hardly larger than itself, where
a license beside it hardly keeps its words from being unique; what was aligned is
aligned again in the span that it reaches over. All places that do not overlap a better one are given, of every license; a place inside a longer
one of another license goes (a notice that quotes part of a text is that text).

Words are compared as hashes, found for a slice of texts at once. A text or window
that holds too few of a template's words, each counted as often as the template
has it at most, cannot cover enough of it and is not aligned; that changes no
result. Only rows with a match leave the scan.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, arrow_map, small_slices, text_bytes
from .runs import tokens

#: Texts of licenses and of the notices that name one; in braces what names it.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the {Apache License}, Version {2.0} (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. {Neither} the name of the copyright holder nor the names of its contributors may be used to {endorse} or
promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the {GNU
General Public License} as published by the Free Software Foundation; either {version 2} of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU
General Public License} as published by the Free Software Foundation, either {version 3} of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the {GNU
Lesser General Public License} as published by the Free Software Foundation; either {version 2.1} of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
for more details.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU
Affero General Public License} as published by the Free Software Foundation, either {version 3} of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License
for more details.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the {Mozilla Public License}, v. {2.0}. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    "GPL-2.0-notice": "This work is licensed under the {GNU General Public License}, version {2}.",
    "GPL-3.0-notice": "This work is licensed under the {GNU General Public License}, version {3}.",
    "LGPL-3.0-notice": "This work is licensed under the {GNU Lesser General Public License}, version {3}.",
    "AGPL-3.0-notice": "This work is licensed under the {GNU Affero General Public License}, version {3}.",
    "CC-BY-4.0-notice": "Licensed under {CC BY 4.0}.",
    "CC-BY-SA-4.0-notice": "Licensed under {CC BY-SA 4.0}.",
    "CC-BY-ND-4.0-notice": "Licensed under {CC BY-ND 4.0}.",
    "CC-BY-NC-4.0-notice": "Licensed under {CC BY-NC 4.0}.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under {CC BY-NC-SA 4.0}.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under {CC BY-NC-ND 4.0}.",
    "CC0-1.0-notice": "Dedicated to the public domain under {CC0 1.0}.",
    "MIT-notice": "Released under the {MIT} License.",
    "BSD-notice": "Released under the {BSD} License.",
    "ISC-notice": "Released under the {ISC} License.",
    "Apache-2.0-notice": "Licensed under the {Apache License}, Version {2.0}.",
    "MPL-2.0-notice": "Licensed under the {Mozilla Public License}, Version {2.0}.",
}


def _longest_rising(values: list[int]) -> list[int]:
    """Places of a longest rising run of ``values``, by piles of cards."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect.bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of aligned words, rising in both. Equal words at the ends of a gap are aligned first."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        both = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        anchors = [both[k] for k in _longest_rising([j for _, j in both])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the words: runs of letters, without case, and of digits."""
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += 32
    sign = ~(((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128))
    low[sign] = 32
    return tokens(low, off)


def template_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _words(raw, np.array([0, len(raw)]))[1]


@dataclass
class Template:
    """A template's words, and where those stand that must be aligned: (place, whether the next must stand beside it)."""

    words: list[int]
    names: list[tuple[int, bool]]

    @staticmethod
    def of(text: str) -> Template:
        found, names = [], []
        for k, part in enumerate(re.split(r"[{}]", text)):
            own = template_words(part).tolist()
            if k % 2:
                names += [(len(found) + i, i + 1 < len(own)) for i in range(len(own))]
            found += own
        return Template(found, names)


def plain(template: str) -> str:
    """The template as it stands in texts."""
    return template.replace("{", "").replace("}", "")


def _names_hold(pairs: list[tuple[int, int]], template: Template) -> bool:
    at = {j: i for i, j in pairs}
    return all(j in at and (not beside or at.get(j + 1) == at[j] + 1) for j, beside in template.names)


def _densest(pairs: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """The longest run of pairs that spans at most ``width`` words, the narrowest and first of such."""
    best, i = (0, 0, 0, 0), 0
    for j in range(len(pairs)):
        while pairs[j][0] - pairs[i][0] >= width:
            i += 1
        best = max(best, (j + 1 - i, pairs[i][0] - pairs[j][0], -i, -j))
    return pairs[-best[2] : 1 - best[3]] if best[0] else []


def windows(n_words: int, n: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all windows: for each size of span up to ``stretch`` template lengths those in which any such span lies."""
    begins, ends, size = [], [], n
    while True:
        size = min(size, stretch * n)
        width, step = size + -(-size // 2), max(1, size // 4)
        begins.append(np.arange(0, max(1, n_words - width + step), step))
        ends.append(np.minimum(begins[-1] + width, n_words))
        if size == stretch * n:
            return np.concatenate(begins), np.concatenate(ends)
        size *= 2


def _aligned(words: np.ndarray, hit: np.ndarray, template: list[int], width: int) -> list[tuple[int, int]]:
    """Pairs of the densest place; ``hit``: where words of the template stand, as others align with nothing."""
    places = hit.tolist()
    return _densest([(places[i], j) for i, j in align(words[hit].tolist(), template)], width)


def find(words: np.ndarray, template: Template, coverage: float, stretch: int = 4) -> list[tuple[int, int, int]]:
    """(aligned words, first word, end) of every place of ``template`` in ``words``, in order."""
    n = len(template.words)
    need = max(1, int(np.ceil(coverage * n)))
    own, limit = np.unique(np.array(template.words, np.uint64), return_counts=True)
    number = np.minimum(np.searchsorted(own, words), len(own) - 1)
    hit = np.flatnonzero(own[number] == words)
    number = number[hit]
    first, last = (np.searchsorted(hit, x) for x in windows(len(words), n, stretch))
    found, seen = set(), set()
    for k in np.flatnonzero(last - first >= need).tolist():
        a, b = int(first[k]), int(last[k])
        if (a, b) in seen or np.minimum(np.bincount(number[a:b], minlength=len(own)), limit).sum() < need:
            continue
        seen.add((a, b))
        pairs = _aligned(words, hit[a:b], template.words, stretch * n)
        if pairs:  # once more with just what the template reaches over: words beside it may have kept its own from being unique
            a, b = np.searchsorted(hit, (pairs[0][0] - pairs[0][1], pairs[-1][0] + n - pairs[-1][1]))
            pairs = max(pairs, _aligned(words, hit[a:b], template.words, stretch * n), key=len)
        if len(pairs) >= need and _names_hold(pairs, template):
            found.add((len(pairs), pairs[0][0], pairs[-1][0] + 1))
    return apart(sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])))


def apart(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of places, the best first, those that do not overlap a better one; in order of the text."""
    kept: list[tuple[int, int, int]] = []
    for n, s, e in places:
        k = bisect.bisect_left(kept, s, key=lambda x: x[1])
        if (k == 0 or kept[k - 1][2] <= s) and (k == len(kept) or kept[k][1] >= e):
            kept.insert(k, (n, s, e))
    return kept


def find_all(words: np.ndarray, templates: dict[str, Template], coverage: float, stretch: int = 4) -> list[tuple[str, int, float, int, int]]:
    """(license, place, coverage, first word, end) of all places but those inside a longer one of another license."""
    found = [(n, s, e, k) for k, t in templates.items() for n, s, e in find(words, t, coverage, stretch)]
    found.sort(key=lambda x: (x[1], -x[2], -x[0], x[3]))
    out, around = [], []  # around: places that reach further than all before them, so the last reaches furthest
    for n, s, e, k in found:
        if around and any(e <= e2 and n <= n2 and k != k2 and (n < n2 or s2 < s or e < e2) for n2, s2, e2, k2 in around):
            continue
        out.append((k, n / len(templates[k].words), s, e))
        around = [x for x in around if x[2] > s] + [(n, s, e, k)]
    order: dict[str, int] = {}
    rows = []
    for k, c, s, e in out:
        rows.append((k, order.setdefault(k, 0), c, s, e))
        order[k] += 1
    return rows


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, coverage: float = 0.8, stretch: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, license, place, coverage, first_word, end_word``: every place of a template in every text.

    ``place`` numbers a license's places in a text from 0. Word numbers count runs
    of letters and of digits. Of overlapping places of one license the one with
    more words is given, of equal ones the narrowest, then the first. A span has at
    most ``stretch`` template lengths. Null, empty and wordless texts match
    nothing. Repeated rows are given back as often as they come, null ids are kept,
    empty tables give empty results, other columns are ignored.
    """
    known = {k: Template.of(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    known = {k: v for k, v in known.items() if v.words}
    if not known:
        known = {"none": Template([0], [])}  # no text holds it
    vocabulary = np.unique(np.concatenate([np.array(v.words, np.uint64) for v in known.values()]))
    limit = np.zeros((len(known), len(vocabulary)), np.int64)
    for k, t in enumerate(known.values()):
        np.add.at(limit[k], np.searchsorted(vocabulary, np.array(t.words, np.uint64)), 1)
    need = np.array([max(1, int(np.ceil(coverage * len(v.words)))) for v in known.values()])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Batches) -> Batches:
        for batch in small_slices(batches, "text", 1_000_000):
            raw, off = text_bytes(batch.column(1))
            text, words = _words(raw, off)
            at = np.searchsorted(text, np.arange(batch.num_rows + 1))
            number = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[number] == words)
            number = number[hit]
            cut = np.searchsorted(hit, at)
            rows, found = [], []
            for d in np.flatnonzero(np.diff(cut) >= need.min()).tolist():
                count = np.bincount(number[cut[d] : cut[d + 1]], minlength=len(vocabulary))
                enough = np.minimum(count, limit).sum(axis=1) >= need
                if enough.any():
                    some = {k: t for (k, t), ok in zip(known.items(), enough.tolist(), strict=True) if ok}
                    places = find_all(words[at[d] : at[d + 1]], some, coverage, stretch)
                    rows += [d] * len(places)
                    found += places
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["id", "license", "place", "coverage", "first_word", "end_word"])

    found = arrow_map(texts, run, f"id {dict(texts.dtypes)['id']}, license string, place int, coverage double, first_word int, end_word int")
    return found.withColumnRenamed("id", id_col)
