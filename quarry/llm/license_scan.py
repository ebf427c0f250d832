"""License scans with a generalised suffix automaton over the words of licence templates.

Texts stream through the automaton word by word: at each place it knows the longest run of words ending there
that stands in any template (matching statistics), and every place of the templates where it does. Runs of ``SHORTEST``
words or more are chained by dynamic programming, in the order of both the text and the template and at most ``GAP`` words
apart in the text; the chain that covers most of a template is taken, then the best one outside its span, and so on, in time in
proportion to the text. A
template covered to ``COVERED`` or more gives its label, if one run of the chain holds its key words (a name with its
version) and no longer chain of another template covers the same span of the text. The base phrases are templates too: one
ends wherever its state is the current one or an ancestor over suffix links and the current run is long enough.

Null text counts as empty: no words, no labels, score 0. Repeated rows get equal rows; very long texts are read whole; extra
columns take no part.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import only, rows_of

SHORTEST, GAP, COVERED = 4, 12, 0.6

# The phrases whose places are counted, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public licence texts and notices: label, key words (consecutive), text.
TEMPLATES = [
    ("mit", "to deal in the Software without restriction", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "to deal in the Software without restriction", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "under the MIT License", "Released under the MIT License"),
    ("mit", "under the MIT License", "Licensed under the MIT License"),
    ("apache-2", "Apache License Version 2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2", "Apache License Version 2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2", "source and binary forms", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3", "endorse or promote products derived from this software without specific prior written permission", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", "with or without fee is hereby granted", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("isc", "with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "in no event will the authors be held liable", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("bsl-1", "Boost Software License Version 1", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense", "free and unencumbered software released into the public domain", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("unlicense", "free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("gpl", "under the GNU General Public License", "Licensed under the GNU General Public License"),
    ("gpl-2", "either version 2 of the License", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "either version 3 of the License", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "either version 2.1 of the License", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3", "GNU Lesser General Public License", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "GNU Affero General Public License", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2", "Mozilla Public License v 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-2", "Mozilla Public License v 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "CC BY NC 4", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Attribution NonCommercial 4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "CC BY NC SA 4", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa", "Attribution NonCommercial ShareAlike 4", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-sa", "CC BY SA 4", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Attribution ShareAlike 4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "CC BY 4", "Licensed under CC BY 4.0"),
    ("cc-by", "Commons Attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "CC0 1", "This work is released under CC0 1.0 Universal"),
]

#: A-Z to a-z; other ASCII but digits and a-z to a space; bytes over 0x7F stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def place_of(words: list[bytes], key: list[bytes]) -> int:
    """Where ``key`` stands in ``words`` first."""
    return next(i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key)


class Automaton:
    """A suffix automaton of several word sequences; each state of ``SHORTEST`` words or more knows all ends of its words in each template."""

    def __init__(self, templates: list[list[bytes]], phrases: list[tuple[list[bytes], str]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.sizes = [len(t) for t in templates]
        for t in [*templates, *(p for p, _ in phrases)]:
            state = 0
            for word in t:
                state = self._extend(state, word)
        ends: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for i, t in enumerate(templates):
            state = 0
            for place, word in enumerate(t):
                state = self.next[state][word]
                ends[state].add((i, place + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] and self.length[self.link[s]] >= SHORTEST:
                ends[self.link[s]] |= ends[s]
        self.ends = [sorted(x) for x in ends]
        own: dict[int, list[tuple[int, str]]] = {}
        for p, label in phrases:
            s = 0
            for word in p:
                s = self.next[s][word]
            own.setdefault(s, []).append((len(p), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.phrases[s] = own.get(s, []) + self.phrases[self.link[s]]

    def _state(self, length: int, of: int | None = None) -> int:
        self.next.append(dict(self.next[of]) if of is not None else {})
        self.link.append(self.link[of] if of is not None else -1)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, parent: int, word: bytes) -> int:
        """The state of ``parent``'s longest words with ``word`` behind, made from the longer one that now holds it."""
        child = self.next[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._state(self.length[parent] + 1, child)
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        self.link[new] = 0 if last < 0 else self._split(last, word)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
        """Runs that can't be made longer to the right, as (end, length, state), and phrases, as (start, words, label)."""
        runs, found = [], []
        nexts, links, lengths, phrases = self.next, self.link, self.length, self.phrases
        state = size = 0
        first = nexts[0]
        for i, word in enumerate(words):
            if not state:
                state = first.get(word, 0)
                size = 1 if state else 0
            else:
                to = nexts[state].get(word)
                if to is None:
                    if size >= SHORTEST:
                        runs.append((i, size, state))
                    while state >= 0 and word not in nexts[state]:
                        state = links[state]
                    if state < 0:
                        state = size = 0
                        continue
                    size = min(size, lengths[state]) + 1
                    state = nexts[state][word]
                else:
                    state = to
                    size += 1
            if phrases[state]:
                found += [(i + 1 - n, n, label) for n, label in phrases[state] if n <= size]
        if size >= SHORTEST:
            runs.append((len(words), size, state))
        return runs, found

    def anchors(self, runs: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """By template: (end in the text, end in the template, words) of each run at each of its places there."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in runs:
            for t, place in self.ends[state]:
                out.setdefault(t, []).append((end, place, size))
        return out


Anchor = tuple[int, int, int]  # end in the text, end in the template, words
Chain = tuple[int, list[Anchor]]  # words covered, anchors


class Chains:
    """The best chains of one template's anchors, one after another, each without the anchors in the spans of those before.

    Anchors are in the order of their ends in the text. Of one that overlaps the chain before it, in either sequence, the words
    behind that one's end count. A chain's anchors go forward in the template and leave at most GAP words between them, so a
    chain has a bounded span: what is taken away changes only a bounded stretch behind it, and all chains of a text are found
    in time in proportion to its anchors.
    """

    def __init__(self, anchors: list[Anchor]):
        self.anchors = anchors
        self.longest = max((size for _, _, size in anchors), default=0)
        self.alive = [True] * len(anchors)
        self.total, self.back = [0] * len(anchors), [-1] * len(anchors)
        for j in range(len(anchors)):
            self._extend(j)

    def _extend(self, j: int) -> bool:
        """Find the best chain that ends with anchor ``j``; whether it is another than before."""
        anchors, total, alive = self.anchors, self.total, self.alive
        end, place, size = anchors[j]
        most, before = size, -1
        i = j - 1
        while i >= 0 and anchors[i][0] >= end - size - GAP:
            if alive[i]:
                e, p, _ = anchors[i]
                more = min(size, end - e, place - p)
                if more > 0 and total[i] + more > most:
                    most, before = total[i] + more, i
            i -= 1
        if (most, before) == (total[j], self.back[j]):
            return False
        total[j], self.back[j] = most, before
        return True

    def best(self, least: float) -> Iterator[Chain]:
        """Those that cover ``least`` words or more, the longest first, of equal ones that which ends first."""
        heap = [(-t, j) for j, t in enumerate(self.total) if t >= least]
        heapq.heapify(heap)
        while heap:
            t, j = heapq.heappop(heap)
            if not self.alive[j] or -t != self.total[j]:
                continue
            chain, i = [], j
            while i >= 0:
                chain.append(self.anchors[i])
                i = self.back[i]
            yield -t, chain[::-1]
            for k in self._take_away(min(e - n for e, _, n in chain), self.anchors[j][0]):
                if self.total[k] >= least:
                    heapq.heappush(heap, (-self.total[k], k))

    def _take_away(self, start: int, end: int) -> Iterator[int]:
        """Drop the anchors that overlap a span; those behind it whose chain changes."""
        anchors, reach = self.anchors, self.longest + GAP
        j = bisect_left(anchors, (start + 1,))
        changed = end
        while j < len(anchors) and anchors[j][0] <= changed + reach:
            if self.alive[j]:
                if anchors[j][0] - anchors[j][2] < end:
                    self.alive[j] = False
                    changed = max(changed, anchors[j][0])
                elif self._extend(j):
                    changed = max(changed, anchors[j][0])
                    yield j
            j += 1


def best_chain(anchors: list[Anchor]) -> Chain:
    """The chain that covers the most words of the template, of equal ones that which ends first."""
    return next(Chains(anchors).best(0), (0, []))


class Disjoint:
    """Spans of which none overlaps another."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Take a span in, unless it overlaps one that is there."""
        at = bisect_left(self.ends, start + 1)  # the first that ends behind the start
        if at < len(self.starts) and self.starts[at] < end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


class Scanner:
    """The automaton of some templates (label, key words, text) and base phrases, and what it finds in a text."""

    def __init__(self, templates: list[tuple[str, str, str]], phrases: dict[str, str]):
        self.labels = [label for label, _, _ in templates]
        texts = [words_of(text) for _, _, text in templates]
        keys = [words_of(key) for _, key, _ in templates]
        self.keys = [(place_of(t, k), place_of(t, k) + len(k)) for t, k in zip(texts, keys, strict=True)]
        self.automaton = Automaton(texts, [(words_of(p), label) for p, label in phrases.items()])

    def _has_key(self, t: int, chain: list[tuple[int, int, int]]) -> bool:
        lo, hi = self.keys[t]
        return any(place - size <= lo and hi <= place for _, place, size in chain)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[str, int, int, float]], float]:
        """Base phrases (start, words, label); spans (label, start, end, share of the template covered); the largest share of any template."""
        runs, phrases = self.automaton.scan(words)
        top, found = 0.0, []
        for t, anchors in self.automaton.anchors(runs).items():
            size = self.automaton.sizes[t]
            chains = Chains(anchors)
            top = max(top, max(chains.total) / size)
            for covered, chain in chains.best(COVERED * size):
                start, end = min(e - n for e, _, n in chain), chain[-1][0]
                if self._has_key(t, chain):
                    found.append((covered, covered / size, t, start, end))
        spans: list[tuple[str, int, int, float]] = []
        taken = Disjoint()
        for _, share, t, start, end in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            if taken.add(start, end):
                spans.append((self.labels[t], start, end, share))
        return phrases, sorted(spans, key=lambda x: x[1]), top


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Words, base phrases, labels, score (1 with a base phrase, else the largest share of a template covered) and spans of every row.

    ``templates`` (label, key words, text) and ``phrases`` may be others, such as whole licences read from files.
    """
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for doc_id, text in rows_of(batches):
            out = []
            for t in text:
                words = words_of(t)
                found, chains, top = scanner.find(words)
                base = sorted({label for _, _, label in found})
                spans = [{"label": label, "start": lo, "end": lo + n, "covered": 1.0} for lo, n, label in found]
                spans += [{"label": label, "start": lo, "end": hi, "covered": share} for label, lo, hi, share in chains]
                starts = [lo for lo, _, _ in found]
                labels = sorted({*base, *(c[0] for c in chains)})
                out.append((len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), 1.0 if found else top, spans))
            cols = [list(c) for c in zip(*out, strict=True)]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            arrays = [pa.array(doc_id, pa.int64())] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)
