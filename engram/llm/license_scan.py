"""Licence scans with a suffix automaton of licence templates.

The words of all templates make one generalised suffix automaton. A document's words are streamed
through it and give, at each word, the longest match that ends there; matches that can't be
extended and are long enough are chained along a template, and a chain that covers enough of the
template labels the document. Of the chains that a match can belong to, the one that covers most is
found by dynamic programming; a word of the document covers one word of the template in it. Words outside the templates' vocabulary can't be matched, so only
runs of vocabulary words are streamed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.textblock import TERM, Block, RollingHash, blocks, lowered, runs

# Phrases that label a document wherever their words stand consecutively.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Sentences of well-known licences and notices, and whole licences, by label.
TEMPLATES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}


@dataclass(frozen=True)
class LicenseRules:
    """``min_match`` words make a match; in a chain a match starts at most ``max_gap`` words after the
    one before ends, in the document; a chain that covers ``min_cover`` of a template is a find."""

    min_match: int = 4
    max_gap: int = 8
    min_cover: float = 0.6
    phrases: dict[str, str] = field(default_factory=lambda: PHRASES)
    templates: dict[str, list[str]] = field(default_factory=lambda: TEMPLATES)


def rules_from(templates: DataFrame, rules: LicenseRules = LicenseRules(), most_words: int = 200_000, label_col: str = "label", text_col: str = "text") -> LicenseRules:
    """Rules with the templates of a table (label, text), such as whole licences.

    Each worker keeps an automaton of all of them, so they are collected, and a table of more than
    ``most_words`` words is refused. Rows with a null label or without words are left out.
    """
    held = templates.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("label IS NOT NULL AND text IS NOT NULL").distinct()
    words = held.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    if words > most_words:
        raise ValueError(f"the templates have {words} words, more than {most_words}")
    found: dict[str, list[str]] = {}
    for row in held.orderBy("label", "text").collect():
        if words_of(row.text):
            found.setdefault(row.label, []).append(row.text)
    return replace(rules, templates=found)


def words_of(text: str) -> list[str]:
    """The words of a text: A-Z in lower case; runs of ASCII letters and digits and of all beyond ASCII."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class SuffixAutomaton:
    """All substrings of several sequences; each state knows where its substrings end in them."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, c in enumerate(sequence):
                last = self._extend(last, c)
                self.ends[last].add((k, at))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, source: int, c: int) -> int:
        """The state of the longest substring of ``source`` followed by c; made if it isn't there yet."""
        target = self.next[source][c]
        if self.length[target] == self.length[source] + 1:
            return target
        clone = self._state(self.length[source] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while source >= 0 and self.next[source].get(c) == target:
            self.next[source][c] = clone
            source = self.link[source]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, c)
        return new

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the matches of at least ``least`` words that can't be extended."""
        state = length = 0
        for at, c in enumerate(words):
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
                continue
            if length >= least:
                yield at, length, state
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
        if length >= least:
            yield len(words), length, state


class Scanner:
    """Templates and phrases, ready to scan blocks."""

    def __init__(self, rules: LicenseRules):
        self.rules = rules
        self.labels, sequences = [], []
        for label, texts in sorted(rules.templates.items()):
            for text in texts:
                self.labels.append(label)
                sequences.append(words_of(text))
        phrases = {p: words_of(p) for p in rules.phrases}
        vocabulary = sorted({w for s in [*sequences, *phrases.values()] for w in s})
        joined = "".join(vocabulary).encode()
        ends = np.cumsum([len(w.encode()) for w in vocabulary])
        hashes = RollingHash(np.frombuffer(joined, np.uint8))(np.append(0, ends[:-1]), ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        code = {vocabulary[i]: k for k, i in enumerate(order)}
        self.sizes = [len(s) for s in sequences]
        self.phrases = [([code[w] for w in words], rules.phrases[p]) for p, words in phrases.items()]
        self.automaton = SuffixAutomaton([[code[w] for w in s] for s in sequences])

    def scan(self, block: Block) -> dict[str, list]:
        texts = len(block.lengths)
        hashed = RollingHash(lowered(block.data))
        starts, ends = block.words(TERM)
        text = block.text_of(starts)
        n_words = np.bincount(text, minlength=texts)
        first = np.concatenate([[0], np.cumsum(n_words)])
        found = hashed(starts, ends)
        slot = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        code = np.where(self.hashes[slot] == found, slot, -1)

        n_base, low, high = np.zeros(texts, np.int64), np.full(texts, -1), np.full(texts, -1)
        base: list[set[str]] = [set() for _ in range(texts)]
        for words, label in self.phrases:
            k = len(words)
            at = np.flatnonzero(code[: len(code) - k + 1] == words[0]) if len(code) >= k else np.zeros(0, int)
            for j in range(1, k):
                at = at[code[at + j] == words[j]]
            at = at[text[at] == text[at + k - 1]]
            for i in at.tolist():
                t, place = int(text[i]), i - int(first[text[i]])
                n_base[t] += 1
                low[t] = place if low[t] < 0 else min(low[t], place)
                high[t] = max(high[t], place)
                base[t].add(label)

        spans: list[list[tuple[str, int, int, float]]] = [[] for _ in range(texts)]
        score = np.zeros(texts)
        inside = code >= 0
        run_starts, run_ends = runs(inside, first)
        long = run_ends - run_starts >= self.rules.min_match
        by_text: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(run_starts[long].tolist(), run_ends[long].tolist(), strict=True):
            t = int(text[a])
            for end, length, state in self.automaton.matches(code[a:b].tolist(), self.rules.min_match):
                by_text.setdefault(t, []).append((a + end - int(first[t]), length, state))
        for t, matches in by_text.items():
            for template, start, end, cover in self._chains(matches):
                score[t] = max(score[t], cover)
                if cover >= self.rules.min_cover:
                    spans[t].append((self.labels[template], start, end, cover))
        return {"n_words": n_words, "n_base": n_base, "first_word": low, "last_word": high, "base": base, "spans": spans, "score": score}

    def _chains(self, matches: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, float]]:
        """Template, first word, end and covered fraction of the best chains along each template.

        ``matches`` (end, length, state) ascend by end. A step from one match of a chain to the next
        leads onwards in the document and in the template and covers what is new in both. For each
        template the chains that cover most are taken first, and others only where they share no
        match with one that was taken.
        """
        steps: dict[int, list[tuple[int, int, int, int]]] = {}  # by template: end, length, last word in it
        for end, length, state in matches:
            for template, last in self.automaton.ends[state]:
                steps.setdefault(template, []).append((end, length, last))
        for template, places in sorted(steps.items()):
            places.sort()
            covers, before, near = [], [], 0
            # a later match can start before one that ends earlier, by its length at most
            longest = max(length for _, length, _ in places)
            for k, (end, length, last) in enumerate(places):
                best, via = length, -1
                while places[near][0] + self.rules.max_gap + longest < end:
                    near += 1
                for j in range(near, k):
                    was_end, _, was_last = places[j]
                    if was_end < end and was_last < last and end - length - was_end <= self.rules.max_gap:
                        fresh = min(length, end - was_end, last - was_last)
                        if covers[j] + fresh > best:
                            best, via = covers[j] + fresh, j
                covers.append(best)
                before.append(via)
            taken = set()
            for k in sorted(range(len(places)), key=lambda k: (-covers[k], k)):
                chain, at = [], k
                while at >= 0:
                    chain.append(at)
                    at = before[at]
                used = {places[j][0] for j in chain}
                if used & taken:
                    continue
                taken |= used
                first = places[chain[-1]]
                yield template, first[0] - first[1], places[k][0], covers[k] / self.sizes[template]


def scan_licenses(docs: DataFrame, rules: LicenseRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` are the finds (label, start, end in words, covered fraction of its template), by start.
    ``score`` is the best covered fraction of any chain, 0 without one. first_word and last_word
    are null without a base place. A null or empty text has no words and no finds. Equal rows get
    equal results, each by itself; ids may be null or repeat; other columns are ignored; an empty
    table gives an empty result.
    """
    rules = rules or LicenseRules()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for block in blocks(batches):
            s = scanner.scan(block)
            none = s["n_base"] == 0
            labels = [sorted(b | {x[0] for x in f}) for b, f in zip(s["base"], s["spans"], strict=True)]
            finds = [[dict(zip(("label", "start", "end", "cover"), x, strict=True)) for x in sorted(f, key=lambda x: (x[1], x[0], x[2]))] for f in s["spans"]]
            cols = [block.rows.column(0), *(pa.array(s[c], pa.int64()) for c in ("n_words", "n_base")), *(pa.array(s[c], pa.int64(), mask=none) for c in ("first_word", "last_word"))]
            cols += [pa.array([",".join(sorted(b)) for b in s["base"]]), pa.array([",".join(x) for x in labels]), pa.array(s["score"]), pa.array(finds, span)]
            yield pa.record_batch(cols, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return rows.mapInArrow(
        scan,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,start:long,end:long,cover:double>>",
    )
