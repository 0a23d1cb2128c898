"""License scans by patience alignment of texts with license templates.

A span of text and a template are aligned by patience: words that both have once are anchors, the longest increasing
subsequence of anchors is kept, and the gaps between them are aligned in the same way; a gap without anchors (all its common words are repeated)
is aligned by its longest common subsequence. A template's coverage is the share of its words that are aligned, and a
span is a find if that reaches the threshold.

Spans to align are found without loss: 2n words of text must share enough words with a template of n words in any order, then in the
template's order (longest common subsequence, which no alignment exceeds); of spans with equally many such words only
those that hold no shorter one count. Finds are the spans without overlap that have most aligned words in all, then fewest words of text.

Edge cases: null and empty texts hold no license; a text may hold several, or one several times, side by side too,
each reported; overlapping finds of one template are reported once, the better ones; a template may consist of common words only, one without
words is never found, and no templates find nothing; repeated rows are scanned each; input columns named
``licenses`` are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

COVERAGE = 0.8
# License notices and texts by SPDX name; "terms" follow the text's first paragraph, so that one passage isn't found twice.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT-terms": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause-terms": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence (of pairs sorted by the first) whose second parts increase, by patience piles; of equally long ones that of the latest pairs."""
    tops: list[int] = []
    piles: list[list[int]] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(piles[p - 1][-1] if p else -1)
        if p == len(tops):
            tops.append(j)
            piles.append([k])
        else:
            tops[p] = j
            piles[p].append(k)
    out, k = [], piles[-1][-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence's positions; a row of bits has a zero for each word of b that adds one."""
    at: dict[str, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    rows = []
    for w in a:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], both increasing."""
    out: list[tuple[int, int]] = []
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
        once = {w for w, n in in_a.items() if n == 1 and in_b.get(w) == 1}
        at_b = {b[j]: j for j in range(b0, b1) if b[j] in once}
        anchors = _increasing([(i, at_b[a[i]]) for i in range(a0, a1) if a[i] in once])
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


def _spans(at: list[tuple[int, int]], n: int, need: float) -> list[tuple[int, int, int]]:
    """(first, last, common): spans of 2n words at most whose longest common subsequence with the template is long
    enough, without those that hold a shorter span with as many; at has positions of the text and the template's bits."""
    full = (1 << n) - 1
    out: list[tuple[int, int, int]] = []
    later: dict[int, int] = {}  # where spans from the next start on reach so many words
    for s in range(len(at) - 1, -1, -1):
        first, v, count, ends = at[s][0], full, 0, {}
        for k in range(s, len(at)):
            last, bits = at[k]
            if last - first >= 2 * n or count == n:
                break
            u = v & bits
            v = ((v + u) | (v - u)) & full
            now = n - v.bit_count()
            if now > count:
                count = now
                if now >= need:
                    ends[now] = last
                    if later.get(now) != last:
                        out.append((first, last, now))
        later = ends
    return out


def _apart(spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans without overlap that have most words (the third) in all, in the fewest words of text."""
    spans = sorted(spans, key=lambda x: x[1])
    lasts = [x[1] for x in spans]
    best, take = [(0, 0)], []
    for first, last, common in spans:
        before = bisect_left(lasts, first)
        with_it = (best[before][0] + common, best[before][1] - (last - first + 1))
        take.append(before if with_it > best[-1] else -1)
        best.append(max(with_it, best[-1]))
    out, k = [], len(spans)
    while k:
        k -= 1
        if take[k] >= 0:
            out.append(spans[k])
            k = take[k]
    return out[::-1]


def _finds(words: list[str], template: list[str], spans: list[tuple[int, int, int]], need: float) -> list[tuple[int, int, int]]:
    """Spans (first, last, aligned) without overlap that have most aligned words in all. Their common words bound that from
    above, so only spans that are chosen by the bound are aligned, and chosen again until the bound is what is aligned."""
    most = {(first, last): common for first, last, common in spans}
    aligned: dict[tuple[int, int], int] = {}
    while True:
        chosen = _apart((*span, n) for span, n in most.items())
        new = [(first, last) for first, last, _ in chosen if (first, last) not in aligned]
        if not new:
            return chosen
        for first, last in new:
            aligned[first, last] = most[first, last] = len(patience(words[first : last + 1], template))
            if most[first, last] < need:
                del most[first, last]


def prepare(templates: dict[str, str]) -> dict[str, tuple[list[str], dict[str, int]]]:
    out = {}
    for name, text in templates.items():
        w = words_of(text)
        bits: dict[str, int] = {}
        for k, x in enumerate(w):
            bits[x] = bits.get(x, 0) | 1 << k
        out[name] = (w, bits)
    return out


def _dense(words: list[str], bits: dict[str, int], n: int, need: float) -> list[list[tuple[int, int]]]:
    """Runs of the template's words (position, bits) in which 2n words of text share enough with it in any order."""
    at = [(k, bits[w]) for k, w in enumerate(words) if w in bits]
    have: dict[int, int] = {}
    runs: list[list[int]] = []
    common = s = 0
    for e, (k, b) in enumerate(at):
        have[b] = have.get(b, 0) + 1
        common += have[b] <= b.bit_count()
        while k - at[s][0] >= 2 * n:
            gone = at[s][1]
            common -= have[gone] <= gone.bit_count()
            have[gone] -= 1
            s += 1
        if common >= need:
            if runs and s <= runs[-1][1]:
                runs[-1][1] = e
            else:
                runs.append([s, e])
    return [at[s : e + 1] for s, e in runs]


def scan(text: str | None, templates: dict[str, tuple[list[str], dict[str, int]]], coverage: float = COVERAGE) -> list[dict]:
    """Finds of each template: name, coverage, matched words, first and last word position of the text."""
    words = words_of(text or "")
    own = set(words)
    out = []
    for name, (template, bits) in templates.items():
        n = len(template)
        # Words of the template that the text has at all bound its coverage from above.
        if sum(w in own for w in template) < coverage * n:
            continue
        for run in _dense(words, bits, n, coverage * n):
            for a, b, matched in _finds(words, template, _spans(run, n, coverage * n), coverage * n):
                out.append({"license": name, "coverage": matched / n, "matched": matched, "first_word": a, "last_word": b})
    return sorted(out, key=lambda x: (x["first_word"], x["license"]))


FIND = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("matched", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """Add licenses: an array of finds (license, coverage, matched, first_word, last_word), empty if none."""
    prepared = prepare(TEMPLATES if templates is None else templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
    return add_columns(docs, text, [T.StructField("licenses", T.ArrayType(FIND))], lambda texts: [pa.array([scan(x, prepared, coverage) for x in texts], kind)])
