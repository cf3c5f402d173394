"""License scan by patience alignment of each text with each template.

Words that occur once in the text's range and once in the template's are anchors; the longest increasing subsequence of
their positions is kept; the gaps before, between and after them are aligned the same way, equal words at a gap's ends first. A gap
without such words is anchored on runs of 2, 4, ... RUN words that occur once in both. Coverage is the share of the
template's words that are aligned, and this alone decides what is a match.

A text may hold a license anywhere and more than once, which would leave no word unique, so stretches are bounded before they are
aligned. Close copies: the stretch with the most common words in order for its length, at most three times the template and
ten words, which tells copies side by side apart. What these leave is searched for scattered copies, whose words have others
between them: ranges whose words make up enough of the template's within ``spread`` words for each of it are aligned as a
whole; where several copies in a range hide each other's anchors, the range is parted at a word of each copy. Words scattered further
than that are no license, and one-line notices (of fewer than LINE words), whose words any long text has in some order, are looked for as
close copies alone.

One narrow map: no shuffle, nothing depends on other documents, and work on a text is linear in its words times the
template's. Templates are a parameter of fixed size.

Every place of every template is reported. The best match is given once more as columns of its own: the most aligned
words, then the greater coverage, then the smaller name, then the first place. Places of one template don't overlap, those
of two may: a notice within a longer one, or a template that another's notice covers.

Edge cases: a null or blank text matches nothing and has an empty list of matches. Repeated rows are scanned each, a null id is an id.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Public licence notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
#: Least coverage of a match.
COVERAGE = 0.75
#: Words of a stretch for each of the template's, words from which on a template is more than a line, and the longest runs as anchors.
SPREAD, LINE, RUN = 8, 40, 32
_WORD = re.compile(r"[0-9a-z]+(?:[.\-][0-9a-z]+)*")


def license_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _once(words: list[str], a: int, b: int, n: int) -> dict:
    """Positions of the words (runs of n words) that occur once between a and b."""
    runs = words[a:b] if n == 1 else list(zip(*(words[a + k : b - n + 1 + k] for k in range(n)), strict=True))
    counts = Counter(runs)
    return {w: i for i, w in enumerate(runs, a) if counts[w] == 1}


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned pairs of positions, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # equal ends
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        n, kept = 1, []
        while not kept and n <= min(RUN, b - a, d - c):  # words that occur once in both, else runs that do; their ends follow as equal ends of gaps
            left, right = _once(text, a, b, n), _once(template, c, d, n)
            pairs = sorted((left[w], j) for w, j in right.items() if w in left)
            kept = [pairs[k] for k in increasing([j for _, j in pairs])]
            n *= 2
        if not kept:
            continue
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(i + 1, x, j + 1, y) for (i, j), (x, y) in zip(edges, edges[1:], strict=False) if i + 1 < x and j + 1 < y]
    return sorted(out)


def places(words: list[str], template: list[str], least: float = COVERAGE, spread: float = SPREAD) -> list[tuple[int, int, int]]:
    """First position, end and aligned words of the template's copies, by position: close ones, then scattered ones between them."""
    taken = close(words, template, least)
    if len(template) < LINE:
        return taken
    reach = int(spread * len(template))
    for i, (a, z, n) in enumerate(taken):  # a close stretch may be the begin of a scattered copy
        if n < len(template):
            x, y = max(taken[i - 1][1] if i else 0, a - reach), min(taken[i + 1][0] if i + 1 < len(taken) else len(words), z + reach)
            wider = [m for m in scattered(words, x, y, template, least, reach) if m[0] < z and a < m[1]]
            if wider and (m := max(wider, key=lambda m: m[2]))[2] > n + 0.05 * len(template):
                taken[i] = m
    edges = [0, *(x for a, z, _ in taken for x in (a, z)), len(words)]
    for a, z in zip(edges[::2], edges[1::2], strict=True):
        taken += scattered(words, a, z, template, least, reach)
    return sorted(taken)


def _ranges(words: list[str], a: int, z: int, template: list[str], need: float, reach: int) -> list[tuple[int, int]]:
    """Ranges between a and z in which some stretch of ``reach`` words has enough of the template's words in any order."""
    counts = Counter(template)
    spots = [i for i in range(a, z) if words[i] in counts]
    held, common, j, out = Counter(), 0, 0, []
    for i in spots:
        while j < len(spots) and spots[j] < i + reach:
            w = words[spots[j]]
            held[w] += 1
            common += held[w] <= counts[w]
            j += 1
        if common >= need:
            end = spots[j - 1] + 1
            if out and i < out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((i, end))
        w = words[i]
        common -= held[w] <= counts[w]
        held[w] -= 1
    return out


def scattered(words: list[str], a: int, z: int, template: list[str], least: float, reach: int) -> list[tuple[int, int, int]]:
    """Copies between a and z whose words have others between them, by alignment of whole ranges."""
    need, out = least * len(template), []
    once = {w: j for w, j in _once(template, 0, len(template), 1).items()}

    def aligned(a: int, z: int) -> tuple[int, int, int] | None:
        """The densest part of a range's alignment that is a copy."""
        at, k = [a + i for i, _ in align(words[a:z], template)], math.ceil(need)
        if not k or len(at) < k:
            return None
        i = min(range(len(at) - k + 1), key=lambda i: at[i + k - 1] - at[i])
        if at[i + k - 1] - at[i] >= reach:
            return None
        j = i + k - 1
        while True:  # grown by the nearer neighbour
            left = at[j] - at[i - 1] if i else reach
            right = at[j + 1] - at[i] if j + 1 < len(at) else reach
            if min(left, right) >= reach:
                return at[i], at[j] + 1, j - i + 1
            i, j = (i - 1, j) if left <= right else (i, j + 1)

    todo = _ranges(words, a, z, template, need, reach)
    while todo:
        x, y = todo.pop()
        if found := aligned(x, y):
            out.append(found)
            todo += [r for u, v in ((x, found[0]), (found[1], y)) for r in _ranges(words, u, v, template, need, reach)]
            continue
        spots: dict[str, list[int]] = {}
        for i in range(x, y):
            if words[i] in once:
                spots.setdefault(words[i], []).append(i)
        times = Counter(len(v) for v in spots.values())
        copies = max((m for m in times if m > 1), key=lambda m: (times[m], m), default=0)
        if copies:  # parted at the first and the last word of the template that each copy has
            each = sorted((once[w], v) for w, v in spots.items() if len(v) == copies)
            first, last = each[0][1], each[-1][1]
            bounds = [(last[i - 1] + 1 if i else x, first[i + 1] if i + 1 < copies else y) for i in range(copies)]
            end = x
            for u, v in bounds:
                if (found := aligned(max(u, end), v)) if max(u, end) < v else None:
                    out.append(found)
                    end = found[1]
    return sorted(out)


def close(words: list[str], template: list[str], least: float = COVERAGE) -> list[tuple[int, int, int]]:
    """First position, end and aligned words of the close stretches that hold enough of the template, by position.

    A stretch is scored by 2 * common words in order / (its words + the template's), counted by a row of bits for the template: a
    bound of what can be aligned. The best one is aligned first (then the first one), and taken if its coverage is
    enough, and so on among those that don't overlap one taken: copies side by side are told apart, since a stretch over two
    scores less than either.
    """
    size, counts = len(template), Counter(template)
    need, full, reach = least * size, (1 << size) - 1, 2 * (size + size // 2 + 5)
    bits = dict.fromkeys(template, 0)
    for j, w in enumerate(template):
        bits[w] |= 1 << j
    spots = [i for i, w in enumerate(words) if w in bits]
    masks = [bits[words[i]] for i in spots]

    def best(k: int, end: int) -> tuple[float, int, int] | None:
        """Score, end and common words of the best stretch that starts at spot k and doesn't pass end."""
        row, got, top, first = full, 0, None, spots[k]
        end = min(end, first + reach)
        for x in range(k, len(spots)):
            i = spots[x]
            total = size + i - first + 1
            if i >= end or (top and 2 * size / total <= top[0]):
                break
            hit = row & masks[x]
            row = ((row + hit) | (row - hit)) & full
            n = size - row.bit_count()
            if n > got:
                got = n
                if n >= need and (top is None or 2 * n / total > top[0]):
                    top = (2 * n / total, i + 1, n)
        return top

    # Starts whose reach holds enough of the template's words in any order: no other start can have a stretch.
    held, common, j, todo = Counter(), 0, 0, []
    for k, i in enumerate(spots):
        while j < len(spots) and spots[j] < i + reach:
            w = words[spots[j]]
            held[w] += 1
            common += held[w] <= counts[w]
            j += 1
        if common >= need and (top := best(k, len(words))):
            todo.append((-top[0], i, top[1], k, top[2]))
        w = words[i]
        common -= held[w] <= counts[w]
        held[w] -= 1
    heapify(todo)
    taken: list[tuple[int, int, int]] = []
    while todo:
        _, a, z, k, n = heappop(todo)
        at = bisect_left(taken, (a + 1,))
        if at and taken[at - 1][1] > a:
            continue
        if at < len(taken) and taken[at][0] < z:
            if top := best(k, taken[at][0]):
                heappush(todo, (-top[0], a, top[1], k, top[2]))
            continue
        if (aligned := len(align(words[a:z], template))) >= need:
            taken.insert(at, (a, z, aligned))
    return taken


def scan(text: str | None, templates: dict[str, list[str]], least: float = COVERAGE) -> list[tuple]:
    """name, aligned words, coverage, first and last word position of every match, by position and name."""
    words = license_words(text) if text else []
    present, out = set(words), []
    for name, template in templates.items():
        if words and sum(w in present for w in template) >= least * len(template):
            out += [(name, n, n / len(template), a, z - 1) for a, z, n in places(words, template, least)]
    return sorted(out, key=lambda m: (m[3], m[4], m[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, the best match (license, n_matched, coverage, first_word, last_word; null without one) and matches, all."""
    split = {k: license_words(v) for k, v in (templates or TEMPLATES).items()}
    fields = ["license", "n_matched", "coverage", "first_word", "last_word"]
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    kind = pa.list_(pa.struct(list(zip(fields, kinds, strict=True))))

    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column("text")]
            found = [scan(t, split, least) for t in texts]
            best = [min(f, key=lambda m: (-m[1], -m[2], m[0], m[3]), default=(None,) * 5) for f in found]
            cols = [pa.array([f[i] for f in best], k) for i, k in enumerate(kinds)]
            matches = pa.array([[dict(zip(fields, m, strict=True)) for m in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(license_words(t)) if t else 0 for t in texts], pa.int64()), *cols, matches], ["doc_id", "n_words", *fields, "matches"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    one = "license string, n_matched long, coverage double, first_word long, last_word long"
    inner = one.replace(" ", ":").replace(",:", ",")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, {one}, matches array<struct<{inner}>>")


def templates_of(table: DataFrame, name: str = "name", text: str = "text") -> dict[str, str]:
    """Templates from a table of whole licence texts. A task holds them all: some hundred licences, by nature of what they are."""
    return {r[0]: r[1] for r in table.where(F.col(name).isNotNull() & F.col(text).isNotNull()).select(name, text).collect()}


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
