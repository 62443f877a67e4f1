"""License scans: winnowed fingerprints find candidate places, banded alignment measures them.

Templates and documents are read as words of lower-cased ASCII letters, digits and non-ASCII bytes; all else
separates. Of each template the least of every `WINNOW` consecutive `GRAM`-word hashes is a fingerprint; an inverted
index names the templates and places of each fingerprint. Where a document has a fingerprint, template and offset
give a diagonal; hits on near diagonals form a candidate window of the document. The template is aligned with the
window by dynamic programming within `BAND` words of the diagonal, for the most matching words (a longest common
subsequence); matched words against the template's words are the coverage, and at `COVERAGE` or more the match is
reported with its span. Where a document has several windows of a template, alignments may also pass from one to a
later one, over an insertion of any length, if the part that follows matches more than `JUMP` words; the span then
covers the insertion.

A match must also name the template's license: of the words that tell licenses apart (`NAMES`, `TERMS` of Creative
Commons, version numbers), the matched parts of the document may hold none that the template lacks and, where the
template is a notice of at most `NOTICE` words, must hold all of it. So a notice of the BSD License isn't one of MIT though four words of five agree, nor CC BY-NC-ND one of CC BY-NC. Of
matches that share a part the one with the larger excess of matched over unmatched template
words stays, so a text isn't reported by a longer license that it is most of.

Any undisturbed run of `GRAM + WINNOW - 1` template words, or of `GRAM` of a notice, which keeps all its hashes, is
sure to hold a fingerprint. Documents are scanned whole,
in the task that reads them; the index is that of the templates given, so nothing is shuffled.

Defined results: null counts as empty and has no matches; repeated rows are reported each; offsets are code points,
ends exclusive. An empty table gives an empty result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import grams, groups_of, texts_of, words_of

GRAM, WINNOW, BAND, COVERAGE, JUMP = 3, 2, 12, 0.8, 8
SLICE = 2 << 20
FOUND = "doc_id long, license string, coverage double, matched_words long, template_words long, start long, end long, licensed_text string"
NAMES = "affero apache apsl artistic boost bsd cc0 cddl cecill eclipse epl eupl gnu gpl agpl lgpl isc lesser mit mozilla mpl unlicense wtfpl zlib".split()
TERMS = "by nc nd sa".split()
NOTICE = 20  # templates of as many words are notices: any number in them is part of a version
PLAIN = np.full(256, 0x20, np.uint8)
PLAIN[0x30:0x3A], PLAIN[0x61:0x7B], PLAIN[0x41:0x5B] = range(0x30, 0x3A), range(0x61, 0x7B), range(0x61, 0x7B)
PLAIN[0x80:] = range(0x80, 0x100)

TEMPLATES = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0 (header)": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-2.1 (header)": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1 (notice)": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 (notice)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 (notice)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT (notice)": "Released under the MIT License.",
    "BSD (notice)": "Released under the BSD License.",
    "ISC (notice)": "Released under the ISC License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0 (notice)": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 (notice)": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 (notice)": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-3.0 (notice)": "Licensed under CC BY 3.0.",
    "CC-BY-SA-3.0 (notice)": "Licensed under CC BY-SA 3.0.",
    "CC-BY-NC-3.0 (notice)": "Licensed under CC BY-NC 3.0.",
    "CC-BY-NC-SA-3.0 (notice)": "Licensed under CC BY-NC-SA 3.0.",
    "All rights reserved (notice)": "All rights reserved.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
}


def plain_words(text: str) -> np.ndarray:
    bounds, data = texts_of(pa.array([text], pa.string()))
    return words_of(bounds, PLAIN[data])[1]


_NAMES = frozenset(int(x) for x in plain_words(" ".join(NAMES)))
_TERMS = frozenset(int(x) for x in plain_words(" ".join(TERMS)))
_NUMBERS = {int(plain_words(str(n))[0]): n for n in range(100)}
_VERSION = frozenset(int(x) for x in plain_words("version v"))


def marks(words: np.ndarray, notice: bool) -> frozenset:
    """What tells licenses apart in `words`: names and, of a notice, terms and numbers, else numbers after "version"."""
    found, after = set(), False
    for word in words.tolist():
        if word in _NUMBERS and (notice or after):
            found.add(_NUMBERS[word])
        else:
            after = word in _VERSION
            if word in _NAMES or notice and word in _TERMS:
                found.add(word)
    return frozenset(found)


class Index:
    """Templates as word hashes, and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.titles = list(templates)
        self.words = [plain_words(t) for t in templates.values()]
        self.notices = [len(words) <= NOTICE for words in self.words]
        self.marks = [marks(words, notice) for words, notice in zip(self.words, self.notices)]
        self.ends_in_number = [int(words[-1]) in _NUMBERS if len(words) else False for words in self.words]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, words in enumerate(self.words):
            gram = grams(words, GRAM)
            if len(gram):
                winnow = 1 if self.notices[number] else WINNOW
                kept = {i + int(np.argmin(gram[i : i + winnow])) for i in range(max(1, len(gram) - winnow + 1))}
                for i in sorted(kept):
                    self.places[int(gram[i])].append((number, i))
        self.fingerprints = np.array(sorted(self.places), np.uint64)

    def names(self, number: int, document: np.ndarray, parts: list[tuple[int, int]]) -> bool:
        """Whether the matched parts name the template's license and no other."""
        found, wanted = marks(np.concatenate([document[a : b + 1] for a, b in parts]), self.notices[number]), self.marks[number]
        if not found <= wanted or self.notices[number] and found != wanted:
            return False
        after = parts[-1][1] + 1
        return not (self.notices[number] and self.ends_in_number[number] and after < len(document) and _NUMBERS.get(int(document[after]), 0))

    def candidates(self, gram: np.ndarray, hits: np.ndarray) -> dict[int, list[int]]:
        """Of each template the starts in the document of hits whose diagonals lie within the band of each other."""
        diagonals = defaultdict(list)
        for at in hits:
            for number, place in self.places[int(gram[at])]:
                diagonals[number].append(int(at) - place)
        found = defaultdict(list)
        for number, starts in diagonals.items():
            last = None
            for start in sorted(starts):
                if last is None or start - last > BAND:
                    found[number].append(start)
                    last = start
        return found


def aligned(template: np.ndarray, document: np.ndarray, start: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last matched place in `document`) of the best alignment near diagonal `start`."""
    n = len(template)
    # cell (i, d): i words of the template used, the document at start + i + d, with d in -band..2 * band
    width = 3 * band + 1
    score, first, last, own = np.zeros(width, np.int64), np.full(width, -1, np.int64), np.full(width, -1, np.int64), np.arange(width)
    for i in range(n):
        places = start + i + np.arange(width) - band
        inside = (places >= 0) & (places < len(document))
        equal = np.zeros(width, bool)
        equal[inside] = document[places[inside]] == template[i]
        # a word of the template without partner: d falls by one; with partner: d stays
        up_score, up_first, up_last = np.append(score[1:], -1), np.append(first[1:], -1), np.append(last[1:], -1)
        meet = score + equal
        better = meet > up_score
        new_first = np.where(better, np.where(equal & (first < 0), places, first), up_first)
        new_last = np.where(better, np.where(equal, places, last), up_last)
        score, first, last = np.where(better, meet, up_score), new_first, new_last
        # words of the document without partner: the nearest best cell before, where it is better
        taken = np.maximum.accumulate(np.where(score == np.maximum.accumulate(score), own, 0))
        score, first, last = score[taken], first[taken], last[taken]
    best = int(np.argmax(score))
    return int(score[best]), int(first[best]), int(last[best])


def chained(template: np.ndarray, document: np.ndarray, starts: list[int], band: int = BAND) -> tuple[int, list[tuple[int, int]]]:
    """(matched words, spans of the parts) of the best alignment that may pass between the windows of `starts`.

    Passing costs `JUMP` matched words; of equal alignments that of the shortest span counts.
    """
    # the windows' diagonals in order; windows that touch are one
    cells = np.unique(np.add.outer(np.array(starts), np.arange(-band, 2 * band + 1)))
    window = np.cumsum(np.diff(cells, prepend=cells[0]) > 1)
    heads = np.flatnonzero(np.diff(window, prepend=-1))
    own, unit = np.arange(len(cells)), len(document) + 1
    # a cell's value: matched words less passes, then the first matched place; `part` is the first place of the last part
    value, matched, passes, first, last, part = (np.full(len(cells), x, np.int64) for x in (0, 0, -1, -1, -1, -1))
    events: list[tuple[int, int, int]] = []
    adjacent = np.append(np.diff(cells) == 1, False)
    for i in range(len(template)):
        places = cells + i
        inside = (places >= 0) & (places < len(document))
        equal = np.zeros(len(cells), bool)
        equal[inside] = document[places[inside]] == template[i]
        meet = np.where(equal, np.where(first < 0, unit + places, value + unit), value)
        up = np.where(adjacent, np.append(value[1:], -1), -1)
        better = meet > up
        taken = np.where(better, own, np.minimum(own + 1, len(own) - 1))
        equal &= better
        value = np.where(better, meet, up)
        matched, passes, first, last, part = matched[taken] + equal, passes[taken], first[taken], last[taken], part[taken]
        first, part, last = np.where(equal & (first < 0), places, first), np.where(equal & (part < 0), places, part), np.where(equal, places, last)
        if len(heads) > 1:  # from the best cell of all earlier windows to a window's head
            most = np.maximum.accumulate(value)
            best = np.maximum.accumulate(np.where(value == most, own, 0))[heads[1:] - 1]
            gain = value[best] - JUMP * unit
            for head, source in zip(heads[1:][gain > value[heads[1:]]], best[gain > value[heads[1:]]]):
                if part[source] < 0:
                    continue
                events.append((int(passes[source]), int(part[source]), int(last[source])))
                value[head], matched[head], first[head], last[head], part[head] = value[source] - JUMP * unit, matched[source], first[source], last[source], -1
                passes[head] = len(events) - 1
        # words of the document without partner
        lifted = value + window * (len(template) + JUMP + 2) * unit
        taken = np.maximum.accumulate(np.where(lifted == np.maximum.accumulate(lifted), own, 0))
        value, matched, passes, first, last, part = (x[taken] for x in (value, matched, passes, first, last, part))
    best = int(np.lexsort((last - first, -(value // unit)))[0])
    parts = [(int(part[best]), int(last[best]))] if part[best] >= 0 else []
    event = int(passes[best])
    while event >= 0:
        event, *span = events[event]
        parts.append(tuple(span))
    return int(matched[best]), parts[::-1]


def matches(template: np.ndarray, document: np.ndarray, starts: list[int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(matched words, spans of the parts) of alignments of `COVERAGE` or more: of each window, and across windows."""
    least = COVERAGE * len(template)
    single = [aligned(template, document, start) for start in starts]
    found = [(m, [(f, e)]) for m, f, e in single if m >= least]
    todo = [(0, len(document))]
    while todo:
        lo, hi = todo.pop()
        # whatever passes between windows is made of parts of single alignments
        near = [(m, start) for (m, f, e), start in zip(single, starts) if m and e >= lo and f < hi]
        if len(near) < 2 or sum(m for m, _ in near) < least:
            continue
        matched, parts = chained(template, document[lo:hi], [start - lo for _, start in near])
        if matched >= least:
            parts = [(f + lo, e + lo) for f, e in parts]
            if len(parts) > 1 or (matched, parts) not in found:
                found.append((matched, parts))
            todo += [(lo, parts[0][0]), (parts[-1][1] + 1, hi)]
            todo += [(a[1] + 1, b[0]) for a, b in zip(parts, parts[1:])]
    return found


def _scanner(templates: dict[str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            bounds, data = texts_of(batch.column("text"))
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, j in groups_of(bounds, SLICE):
                lo, hi = bounds[i], bounds[j]
                plain = PLAIN[data[lo:hi]]
                firsts, hashes = words_of(bounds[i : j + 1] - lo, plain)
                gram = grams(hashes, GRAM)
                hits = np.flatnonzero(np.isin(gram, index.fingerprints))
                owner = np.searchsorted(firsts, hits, "right") - 1
                whole = hits + GRAM <= firsts[owner + 1]
                hits, owner = hits[whole], owner[whole]
                for text in np.unique(owner):
                    words = hashes[firsts[text] : firsts[text + 1]]
                    found = []
                    for number, starts in index.candidates(gram[firsts[text] :], hits[owner == text] - firsts[text]).items():
                        template = index.words[number]
                        for matched, parts in matches(template, words, starts):
                            if not index.names(number, words, parts):
                                continue
                            found.append((len(template) - 2 * matched, parts[-1][1] - parts[0][0], parts[0][0], parts[-1][1], number, matched, parts))
                    kept: list[tuple] = []
                    for match in sorted(found):
                        if all(a[1] < b[0] or a[0] > b[1] for k in kept for a in match[-1] for b in k[-1]):
                            kept.append(match)
                    if kept:
                        a, b = int(bounds[i + text] - lo), int(bounds[i + text + 1] - lo)
                        rows += [(ids[i + text], index.titles[n], m / len(index.words[n]), m, len(index.words[n]), *_span(data[lo + a : lo + b], plain[a:b], f, e)) for _, _, f, e, n, m, _ in sorted(kept, key=lambda k: k[2:4])]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = ("doc_id", "license", "coverage", "matched_words", "template_words", "start", "end", "licensed_text")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names)

    return scan


def _span(raw: np.ndarray, plain: np.ndarray, first: int, last: int) -> tuple[int, int, str]:
    """Code-point offsets of words `first` to `last` of a text, and the text there."""
    is_word = np.concatenate(([False], plain != 0x20, [False]))
    starts, ends = np.flatnonzero(is_word[1:-1] & ~is_word[:-2]), np.flatnonzero(is_word[1:-1] & ~is_word[2:]) + 1
    a, b = int(starts[first]), int(ends[last])
    lead = int(np.count_nonzero((raw[:a] & 0xC0) != 0x80))
    text = raw[a:b].tobytes().decode()
    return lead, lead + len(text), text


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each match: doc_id, license, coverage, matched_words, template_words, start, end, licensed_text."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(_scanner(templates or TEMPLATES), FOUND)
