"""Licence scans with a generalised suffix automaton of licence tokens.

All templates' words are put into one suffix automaton. A document is streamed through it word by
word, which gives the matching statistics: the longest run of words ending here that some template
has. A run that cannot be extended is a maximal match; matches of at least ``MIN_MATCH`` words that
follow each other in the document and in one template are chained so that most words are covered
(dynamic programming over their places in text and template), and a template whose chain covers
enough of its words labels the document. Base phrases are templates too; a place of a base
phrase is a position whose matching statistic reaches the phrase's state.

Only runs of words that occur in templates are streamed; any other word puts the automaton back to
its start, so leaving such words out changes nothing.

Defined cases: null and empty texts have no words, no places, empty labels and score 0; overlapping
places all count; of equally long chains the one that ends first counts; null ids and repeated rows
are scanned like any other; a text of any length is scanned in one pass, holding its words; an empty
table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.runtime import documents, utf8

#: Base phrases and labels: fixed values.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices, grants and bodies of licences; a document has the label if enough of one of its texts is covered.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd", """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("gpl-3", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("bsl-1", """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
]
#: Words of a match that may be chained, words skipped between chained matches, share covered.
MIN_MATCH, GAP, COVER = 3, 4, 0.8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case runs of ASCII letters, digits and bytes beyond ASCII."""
    return text.translate(_LOWER).split()


class SuffixAutomaton:
    """Of several word sequences; a state holds the places (sequence, end) of its words."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, at))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The target of state's step, as a state of its own if longer words share it."""
        target = self.step[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def stream(self, sequence: list[int]) -> tuple[list[int], list[int]]:
        """The state and the matching statistic after each word."""
        step, link, length = self.step, self.link, self.length
        state, n, states, matched = 0, 0, [], []
        for word in sequence:
            while state and word not in step[state]:
                state = link[state]
                n = length[state]
            if word in step[state]:
                state, n = step[state][word], n + 1
            states.append(state)
            matched.append(n)
        return states, matched


class Scanner:
    """Phrases and templates, and what of them a document has."""

    def __init__(self, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> None:
        self.phrases = list((PHRASES if phrases is None else phrases).items())
        self.templates = [*((label, p) for p, label in self.phrases), *(TEMPLATES if templates is None else templates)]
        texts = [words_of(t.encode()) for _, t in self.templates]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.sequences = [[self.ids[w] for w in t] for t in texts]
        self.automaton = SuffixAutomaton(self.sequences)
        # The phrases that end wherever a state is reached: those of its chain of suffix links.
        self.ending: list[list[int]] = [[] for _ in self.automaton.step]
        for number, sequence in enumerate(self.sequences[: len(self.phrases)]):
            state = 0
            for word in sequence:
                state = self.automaton.step[state][word]
            self.ending[state].append(number)
        for state in sorted(range(1, len(self.ending)), key=self.automaton.length.__getitem__):
            self.ending[state] = self.ending[state] + self.ending[self.automaton.link[state]]
        self.shortest = min(MIN_MATCH, *(len(s) for s in self.sequences[: len(self.phrases)] or [[0] * MIN_MATCH]))

    def runs(self, words: list[bytes]) -> list[tuple[int, list[int]]]:
        """(start, ids) of the runs of template words that could hold a phrase or match."""
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]])))
        return [(a, ids[a:b].tolist()) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= self.shortest]

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int, int]] = []  # template, first word in it, first word in the text, words
        for start, ids in self.runs(words):
            states, matched = self.automaton.stream(ids)
            for at, (state, n) in enumerate(zip(states, matched, strict=True)):
                if n >= self.shortest:
                    for number in self.ending[state]:
                        if n >= (size := len(self.sequences[number])):
                            places.append((start + at - size + 1, self.phrases[number][1]))
                if n >= MIN_MATCH and (at + 1 == len(ids) or matched[at + 1] <= n):
                    matches += [(number, end - n + 1, start + at - n + 1, n) for number, end in self.automaton.ends[state]]
        labels, best, spans = {label for _, label in places}, 0.0, []
        for number, cover, first, last, alone in self.chains(matches):
            best = max(best, cover)
            if alone and cover >= (COVER if len(self.sequences[number]) > 8 else 1.0):
                labels.add(self.templates[number][0])
                spans.append({"label": self.templates[number][0], "first": first, "last": last, "cover": cover})
        base = sorted({label for _, label in places})
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places)[0] if places else None,
            "last_word": max(places)[0] if places else None,
            "base_labels": ",".join(base),
            "labels": ",".join(sorted(labels)),
            "score": 1.0 if base else min(1.0, best),
            "spans": sorted(spans, key=lambda s: (s["first"], s["last"], s["label"])),
        }

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, float, int, int, bool]]:
        """(template, share covered, first and last word in the text, whether it tells the label) of each
        chain of matches that follow each other, in text and template, with at most GAP words between.

        A chain tells the label if one of its matches stands in templates of that label only: words that
        several licences share say nothing.

        The best chain that ends with a match extends the best one of a match before it; matches that
        overlap count once. Chains are read off from the longest down, each match in one of them.
        """
        out = []
        by_template: dict[int, set[tuple[int, int, int]]] = {}
        labels: dict[tuple[int, int], set[str]] = {}
        for number, inside, start, n in matches:
            by_template.setdefault(number, set()).add((start, inside, n))
            labels.setdefault((start, n), set()).add(self.templates[number][0])
        for number, own in sorted(by_template.items()):
            for covered, first, last, chain in self._longest(sorted(own)):
                out.append((number, covered / len(self.sequences[number]), first, last, any(len(labels[start, n]) == 1 for start, _, n in chain)))
        return out

    @staticmethod
    def _longest(own: list[tuple[int, int, int]]) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(words covered, first and last word in the text, matches) of chains of matches (place in the
        text, place in the template, words) in order."""
        best, before = [0] * len(own), [-1] * len(own)
        near: list[int] = []  # matches whose end is not too far back
        for j, (start, inside, n) in enumerate(own):
            near = [i for i in near if own[i][0] + own[i][2] >= start - GAP]
            best[j] = n
            for i in near:
                at, within, m = own[i]
                shared = max(0, at + m - start, within + m - inside)
                fits = at < start and within < inside and shared < n and start + shared - at - m <= GAP and inside + shared - within - m <= GAP
                if fits and best[i] + n - shared > best[j]:
                    best[j], before[j] = best[i] + n - shared, i
            near.append(j)
        out, used = [], set()
        for j in sorted(range(len(own)), key=lambda j: (-best[j], own[j][0] + own[j][2], j)):
            if j in used:
                continue
            last, i, chain = j, j, []
            while i >= 0 and i not in used:
                used.add(i)
                chain.append(own[i])
                last, i = i, before[i]
            out.append((best[j] - (best[i] if i >= 0 else 0), own[last][0], own[j][0] + own[j][2] - 1, chain))
        return out


@cache
def scanner() -> Scanner:
    return Scanner()


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts, places, labels, score and covered template spans."""

    def run(batches):
        own = scanner()
        for b in batches:
            found = [own.scan(t) for t in utf8(b["body"].tolist())]
            out = pd.DataFrame(found, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"}).assign(id=b["id"].values)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,cover:double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def op7(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("spans")


