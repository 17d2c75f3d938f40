"""License scan by patience alignment of texts with license templates.

A template may match a document only if enough of its words occur there.  For
each place of its rarest word in the document, the words around are aligned
with the template: words that are unique to both sides are anchors, the longest
increasing subsequence of their places is kept, and each gap between anchors is
aligned the same way, after its equal ends are matched.  Coverage is the share
of the template's words that are matched; matches that lie apart in the text by
more than the template allows are not counted together.

Defined results: null or empty text has no license; a null ``doc_id`` is a
document like any other; repeated rows each get a row; of matches that overlap
the one of larger coverage counts, then that of more words, then the first by
name; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.store import pick, table

# License texts and notices as their publishers give them, each with the name that it stands for.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
GPL_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT),
    ("MIT", f"{MIT} {AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {ISC_WARRANTY}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {ISC_WARRANTY}"),
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", f"{BSD_2} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_2} {BSD_3}"),
    ("BSD-3-Clause", f"{BSD_2} {BSD_3} {BSD_WARRANTY}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {GPL_WARRANTY}"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. {GPL_WARRANTY}"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {AS_IS} IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("all-rights-reserved", "All rights reserved."),
)

COVERAGE = 0.85
#: How far n words of a template may reach in the text: n * STRETCH + SLACK words.
STRETCH, SLACK = 1.35, 1

_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes beyond ASCII, in lower case."""
    return (text or b"").translate(_LOWERED).split()


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, which rise in the first, that rises in the second as well."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect.bisect_left(tails, b)
        back[k] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [b], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def unique(side: list[bytes], low: int, high: int) -> dict[bytes, int]:
    """Places of the words that occur once in side[low:high]."""
    seen: dict[bytes, int] = {}
    for k in range(low, high):
        seen[side[k]] = -1 if side[k] in seen else k
    return {w: k for w, k in seen.items() if k >= 0}


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """(place in text, place in template) of matched words, rising in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = unique(text, a, b), unique(template, c, d)
        anchors = rising(sorted((ours[w], theirs[w]) for w in theirs if w in ours))
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def densest(matched: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The most matches whose places in the text lie within reach."""
    best, low = (0, 0), 0
    for high in range(len(matched)):
        while matched[high][0] - matched[low][0] >= reach:
            low += 1
        if high + 1 - low > best[1] - best[0]:
            best = (low, high + 1)
    return matched[best[0] : best[1]]


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.all = [(name, w) for name, t in templates if (w := words(t.encode()))]
        self.lexicon = frozenset(w for _, t in self.all for w in t)

    def found(self, text: bytes | None, least: float = COVERAGE) -> list[tuple[int, int, str, float]]:
        """(start, end, name, coverage): matches that don't overlap, by start; places are words of the text."""
        w = words(text)
        here = self.lexicon.intersection(w)
        todo = [(name, t) for name, t in self.all if sum(x in here for x in t) >= least * len(t)]
        if not todo:
            return []
        places: dict[bytes, list[int]] = {}
        for k, x in enumerate(w):
            if x in here:
                places.setdefault(x, []).append(k)
        hits = []
        for name, t in todo:
            # an occurrence lacks at most this many words, so one of the rarest that many and one must be in it
            lacks = int(len(t) * (1 - least) + 1e-9)
            rare = sorted(set(t), key=lambda x: (len(places.get(x, ())), x))
            some, need = [], lacks + 1
            for x in rare:
                some.append(x)
                need -= t.count(x)
                if need <= 0:
                    break
            reach, done = int(len(t) * STRETCH) + SLACK, 0
            at = {x: [j for j, y in enumerate(t) if y == x] for x in some}
            for k, j in sorted((k, j) for x in some for k in places.get(x, ()) for j in at[x]):
                if k < done:
                    continue
                low, high = max(done, k - int(j * STRETCH) - SLACK), min(len(w), k + int((len(t) - j) * STRETCH) + SLACK)
                matched = densest(align(w[low:high], t), reach)
                if len(matched) >= least * len(t):
                    start, end = low + matched[0][0], low + matched[-1][0] + 1
                    hits.append((-len(matched) / len(t), -len(matched), name, start, end))
                    done = end
        taken: list[tuple[int, int, str, float]] = []  # by start, and so by end: they don't overlap
        for minus, _, name, start, end in sorted(hits):
            at = bisect.bisect_left(taken, (start,))
            if (not at or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                taken.insert(at, (start, end, name, -minus))
        return taken


def licensed(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """doc_id, n_licenses, license (of most coverage), coverage, found (name:start:end:coverage, joined by commas) for each row."""

    def run(batches):
        known = Templates(templates)
        for b in batches:
            got = [known.found(t.as_py(), least) for t in b.column("text")]
            best = [min(g, key=lambda m: (-m[3], m[0]), default=None) for g in got]
            yield pa.record_batch(
                [
                    b.column("doc_id"), pa.array([len(g) for g in got], pa.int64()), pa.array([m and m[2] for m in best], pa.string()), pa.array([m[3] if m else 0.0 for m in best], pa.float64()),
                    pa.array([",".join(f"{n}:{s}:{e}:{c:.4f}" for s, e, n, c in g) for g in got], pa.string()),
                ],
                ["doc_id", "n_licenses", "license", "coverage", "found"],
            )

    return pick(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_licenses long, license string, coverage double, found string")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """The licenses of every document."""
    return licensed(table(spark, sf_dir, "documents"))
