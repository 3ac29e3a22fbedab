"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template. A text's words are read through it once; after each word its
state and length say how long a match ends there (matching statistics). Phrases are templates of their own: one ends
at a word if its state lies on the suffix links of the current one and the match is as long. Matches of MIN_MATCH
words and more that cannot be extended are chained: the next one follows within GAP words in the text and stands
later in the same template, at any of the places where the template has its words. A template whose best chain covers COVER of it gives its label; the score is the largest
share that any template or phrase has covered.

The automaton is small (it grows with the templates only) and travels to the executors with the function. A text is
read in one pass, so memory is that of its words.

Defined results: a null text is empty: no words, no places, score 0. Repeated rows give a row each, an empty table an
empty result; ties between templates give every label.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER

MIN_MATCH = 4
GAP = 8
COVER = 0.6

#: Fixed values of the base scan: phrase and label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Wordings of notices and of clauses that make a licence known, by label.
TEMPLATES = (
    ("agpl", "gnu affero general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including "
        "all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any "
        "damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions "
        "of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the "
        "above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this "
        "software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties "
        "of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
        "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
        "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
        "any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of "
        "this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it "
        "freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must "
        "be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_TO_WORDS = bytes(int(LOWER[i]) if ALNUM[LOWER[i]] else 0x20 for i in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton over word numbers; states by index, 0 the root."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [words(t) for t in (*(t for _, t in templates), *(p for p, _ in phrases))]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(t) for t in texts]
        for t in texts:
            last = 0
            for w in t:
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
        # where in each template a state's matches end, carried from long states to their suffixes
        ends: list[dict[int, set[int]]] = [{} for _ in self.next]
        locus = []
        for k, t in enumerate(texts):
            state = 0
            for j, w in enumerate(t):
                state = self.next[state][self.number[w]]
                if k < len(templates):
                    ends[state].setdefault(k, set()).add(j + 1)
            locus.append(state)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for k, js in ends[s].items():
                ends[self.link[s]].setdefault(k, set()).update(js)
        self.ends = [{k: sorted(js) for k, js in held.items()} for held in ends]
        own: dict[int, list[tuple[str, int]]] = {}
        for (_, label), state, size in zip(phrases, locus[len(templates):], self.sizes[len(templates):], strict=True):
            own.setdefault(state, []).append((label, size))
        self.said: list[list[tuple[str, int]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.said[s] = own.get(s, []) + self.said[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        """A state for the shorter strings of q, which get an end that q's longer ones lack."""
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, to: dict[int, int], length: int) -> int:
        self.next.append(to)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, str, int]], list[tuple[int, int, int]]]:
        """Phrases (start, label, words) and the matches that cannot be extended (start, end, state)."""
        number, nexts, link, lengths, said = self.number.get, self.next, self.link, self.length, self.said
        phrases, matches = [], []
        state = size = 0
        before = -1
        for i, c in [(i, c) for i, c in enumerate(map(number, text)) if c is not None]:
            if i != before + 1:
                if size >= MIN_MATCH:
                    matches.append((before + 1 - size, before + 1, state))
                state = size = 0
            before = i
            if c not in nexts[state]:
                if size >= MIN_MATCH:
                    matches.append((i - size, i, state))
                while state and c not in nexts[state]:
                    state = link[state]
                    size = lengths[state]
            state = nexts[state].get(c, 0)
            size = size + 1 if state else 0
            if said[state]:
                phrases += [(i - n + 1, label, n) for label, n in said[state] if size >= n]
        if size >= MIN_MATCH:
            matches.append((before + 1 - size, before + 1, state))
        return phrases, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """For each template with a chain: the share of it covered, first word and end of the best chain."""
        best: dict[int, tuple[float, int, int]] = {}
        recent: dict[int, list[tuple[int, int, int, int]]] = {}  # end in the text, in the template, words, start of the chain
        for start, end, state in matches:
            for k, places in self.ends[state].items():
                near = [r for r in recent.get(k, []) if start - r[0] <= GAP]
                recent[k] = [*near]
                for at in places:
                    ok = [r for r in near if r[0] <= start and r[1] <= at - (end - start)]
                    held = max(ok, key=lambda r: (r[2], -r[3]), default=(0, 0, 0, start))
                    now = (end, at, held[2] + end - start, held[3])
                    recent[k].append(now)
                    share = min(1.0, now[2] / self.sizes[k])
                    if share > best.get(k, (0.0,))[0]:
                        best[k] = (share, now[3], end)
        return best


def spans(text: str | None, automaton: Automaton) -> list[tuple[str, int, int, float]]:
    """label, first word, end and share covered of each template found in a text."""
    _, matches = automaton.scan(words(text))
    return [(automaton.labels[k], a, b, share) for k, (share, a, b) in sorted(automaton.chains(matches).items()) if share >= COVER]


def scan(docs: DataFrame, automaton: Automaton | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans, one row for each of docs (doc_id, text).

    spans are label:first:end of every base place and of the best chain of every template found, words from 0, end exclusive,
    by first, end and label, comma-joined. Other columns of docs are left out."""
    automaton = automaton or Automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                held = words(text.as_py())
                phrases, matches = automaton.scan(held)
                chains = automaton.chains(matches) if matches else {}
                base = {label for _, label, _ in phrases}
                more = base | {automaton.labels[k] for k, c in chains.items() if c[0] >= COVER}
                at = [p for p, _, _ in phrases]
                score = max([1.0 if phrases else 0.0, *(c[0] for c in chains.values())])
                found = {(p, p + n, label) for p, label, n in phrases} | {(c[1], c[2], automaton.labels[k]) for k, c in chains.items() if c[0] >= COVER}
                said = ",".join(f"{label}:{a}:{b}" for a, b, label in sorted(found))
                rows.append((len(held), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(more)), score, said))
            made = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
