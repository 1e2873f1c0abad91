"""License scans by a generalised suffix automaton.

The automaton holds every run of words of all templates. A file is streamed through it once: at each word it gives the
longest run ending there that some template contains (the matching statistics), and over suffix links the shorter runs that
other templates contain. Long matches of one template are chained
in order into the template words they cover; the covered share is the score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import alnum_words, pick, read, text_map

#: Phrases whose every place is reported, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Openings, notices and disclaimers of public licences, with their labels; each is a template by itself.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: A match of fewer words than this is not chained.
MIN_MATCH = 6
#: A label of the method needs this share of its template covered.
MIN_COVER = 0.5


class Automaton:
    """Generalised suffix automaton over word ids; templates and phrases are its strings."""

    def __init__(self, templates: tuple, phrases: tuple) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]  # (template, end word) of all places of a state's runs
        self.words: dict[bytes, int] = {}
        self.labels, self.sizes, self.texts = [], [], []
        for label, text in templates:
            self._add(alnum_words(text), len(self.labels))
            self.labels.append(label)
            self.texts.append([self.words[w] for w in alnum_words(text)])
            self.sizes.append(len(self.texts[-1]))
        for text, _ in phrases:
            self._add(alnum_words(text), -1)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= MIN_MATCH:  # shorter runs are not asked for
                self.places[self.link[state]] |= self.places[state]
        ends: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for text, label in phrases:
            state = 0
            for w in alnum_words(text):
                state = self.next[state][self.words[w]]
            ends[state].append((len(alnum_words(text)), label))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            ends[state] = ends[state] + ends[self.link[state]]
        self.phrases = ends  # phrases that end wherever a state is reached by a match of their length

    def _add(self, words: list[bytes], template: int) -> None:
        last = 0
        for at, word in enumerate(words):
            last = self._extend(last, self.words.setdefault(word, len(self.words)))
            if template >= 0:
                self.places[last].add((template, at))

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, c, self.next[p][c])
        return cur

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int, int]]]:
        """Places (start, words, label) of phrases, and maximal matches (template, its start word, start in the file, words)."""
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(ids >= 0)
        places, matches = [], []
        state = size = 0
        before = -2
        after = [*ids[1:].tolist(), -1]
        for at, c in zip(known.tolist(), ids[known].tolist()):
            if at != before + 1:
                state = size = 0
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(c)
            if to is not None:
                state, size = to, size + 1
            before = at
            if size >= MIN_MATCH:
                self._ended(state, size, at, after[at], matches)
            for n, label in self.phrases[state]:
                if size >= n:
                    places.append((at - n + 1, n, label))
        return places, matches

    def _ended(self, state: int, size: int, end: int, following: int, matches: list) -> None:
        """The runs that end here and that the file's next word does not prolong: the longest at the state's places, shorter ones at those that only its suffixes have."""
        seen: set[tuple[int, int]] = set()
        while size >= MIN_MATCH:
            for template, at in self.places[state] - seen:
                if self.texts[template][at + 1 : at + 2] != [following]:
                    matches.append((template, at - size + 1, end - size + 1, size))
            seen = self.places[state]
            state = self.link[state]
            size = self.length[state]

    def covers(self, matches: list[tuple[int, int, int, int]]) -> dict[str, float]:
        """Of each label, the largest share of a template's words in the best chain of matches that stand in its order; overlapping words count once."""
        by = defaultdict(list)
        for m in matches:
            by[m[0]].append(m[1:])
        out = {}
        for template, found in by.items():
            # Longest chain by a prefix maximum over the template's words: matches come in file order.
            best = np.zeros(self.sizes[template] + 1)
            for start, _, size in found:
                end = start + size
                # A chain that reaches past this match's start gains only the words beyond it.
                reach = np.arange(end + 1)
                gain = (best[: end + 1] + end - np.maximum(reach, start)).max()
                best[end] = max(best[end], gain)
            label = self.labels[template]
            out[label] = max(out.get(label, 0.0), float(best.max()) / self.sizes[template])
        return out


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton(TEMPLATES, PHRASES)


def scanner() -> Callable[[list], list]:
    own = automaton()

    def work(texts: list) -> list:
        rows = []
        for text in texts:
            words = alnum_words(text)
            places, matches = own.scan(words)
            covers = own.covers(matches) if matches else {}
            base = {label for *_, label in places}
            starts = [s for s, *_ in places]
            method = {k for k, v in covers.items() if v >= MIN_COVER}
            score = max([*covers.values(), 0.0])
            spans = sorted({(s, s + n) for *_, s, n in matches})
            rows.append((
                len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | method)), min(score, 1.0),
                [{"start": s, "end": e} for s, e in spans],
            ))
        return rows

    return work


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: n_words, n_base, first_word, last_word, base_labels, labels, score and spans (matched word ranges, end exclusive).

    score is the largest covered share of a template, 0 without a match of MIN_MATCH words. A null or empty text has no
    words, null places, empty labels and score 0. Null ids and repeated rows give a row each; an empty table an empty one;
    other columns are not read. Files are streamed whole; each is scanned where it lies, without a shuffle.
    """
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int>>"
    return text_map(pick(docs, doc_id=doc_id, text=text), scanner, schema)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")
