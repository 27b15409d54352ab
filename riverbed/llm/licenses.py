"""License scans by template markup.

A template is a license notice whose words must stand as they are, except in marked regions: ``[[...]]`` may be absent and
``{{n}}`` stands for up to n words of any kind. Templates compile to automata over word tokens; a text has the license if
some run of its words takes an automaton from its start to its end. Bodies are whole, so that a license that holds
another's sentences beside its own isn't taken for that one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm import kernels as K
from riverbed.llm.common import spread

# The phrases of the base labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Wording that several of the licenses share.
MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
 software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
 and or sell copies of the software and to permit persons to whom the software is furnished to do so"""
MIT_DISCLAIMER = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
 merchantability fitness for a particular purpose and noninfringement in no event shall {{12}} be liable for any claim damages or other liability
 whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
ISC_DISCLAIMER = """the software is provided as is and {{6}} disclaims all warranties with regard to this software including all implied warranties of
 merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever
 resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with
 the use or performance of this software"""
BSD_GRANT = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are
 met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]]
 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
 and or other materials provided with the distribution"""
BSD_NAMES = """[[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software
 without specific prior written permission"""
BSD_DISCLAIMER = """this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties
 of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special
 exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
 interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
 any way out of the use of this software even if advised of the possibility of such damage"""
GNU = "[[you can redistribute it and or modify it]] under the terms of the gnu {} public license [[as published by the free software foundation]] [[either]] version {}"

# Bodies and notices of common licenses, with their optional and replaceable regions marked.
TEMPLATES = (
    ("mit", "[[this {{4}} is]] released under the [[terms of the]] mit license"),
    ("mit", "[[this {{4}} is]] licensed under the [[terms of the]] mit license"),
    ("mit", f"{MIT_GRANT} subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {MIT_DISCLAIMER}"),
    ("mit-0", f"{MIT_GRANT} {MIT_DISCLAIMER}"),
    ("isc", f"{ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies {ISC_DISCLAIMER}"),
    ("0bsd", f"{ISC_GRANT} {ISC_DISCLAIMER}"),
    ("bsd-2", f"{BSD_GRANT} {BSD_DISCLAIMER}"),
    ("bsd-3", f"{BSD_GRANT} {BSD_NAMES} {BSD_DISCLAIMER}"),
    ("apache-2", "[[this {{4}} is]] licensed under the apache license version 2 0 [[the license]]"),
    ("gpl-2", "[[this {{4}} is]] licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 2"),
    ("gpl-3", "[[this {{4}} is]] licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 3"),
    ("lgpl-3", "[[this {{4}} is]] licensed under the [[terms of the]] gnu lesser general public license version 3"),
    ("gpl-2", GNU.format("general", "2")),
    ("gpl-3", GNU.format("general", "3")),
    ("lgpl-2.1", GNU.format("lesser general", "2 1")),
    ("lgpl-3", GNU.format("lesser general", "3")),
    ("agpl-3", GNU.format("affero general", "3")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {{6}}]]"),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
 from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it
 and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that
 you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not
 required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice
 may not be removed or altered from any source distribution"""),
    ("bsl-1", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
 covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the
 software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and
 this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software
 in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object
 code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited
 to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone
 distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with
 the software or the use or other dealings in the software"""),
    ("unlicense", f"""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
 distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in
 jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public
 domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an
 overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {MIT_DISCLAIMER}"""),
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution [[4 0]] [[international]] license"),
    ("cc-by-nc", "licensed under cc by nc [[{{1}} 0]]"),
    ("cc-by-sa", "licensed under cc by sa [[{{1}} 0]]"),
    ("cc0", "released under cc0 [[1 0]]"),
)
#: ASCII bytes that part words: all but digits and (lower-cased) letters.
APART = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
ANY = -2
#: Marks beyond ASCII that part words for the templates: quotation marks, dashes, dots, signs of copyright, blanks. The base phrases see them as letters.
MARKS = "[\u2010-\u2015\u2018-\u201f\u2022\u2026\u2032\u2033\u2039\u203a\u2122\u00a0\u00a9\u00ab\u00ae\u00b7\u00bb\u3000\u300c\u300d\u2002-\u200b\ufeff]"


class Automaton:
    """States of a template: ``step[s]`` lists (token, next), ``ANY`` for any word; ``free[s]`` the states reached for nothing."""

    def __init__(self, label: str, markup: str, ids: dict[str, int]):
        self.label, self.step, self.free, self.depth = label, [[]], [set()], [0]
        optional: list[int] = []
        last = must = 0
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\w+", markup):
            if part == "[[":
                optional.append(last)
            elif part == "]]":
                self.free[optional.pop()].add(last)
            elif part.startswith("{{"):
                begin = last
                for _ in range(int(part[2:-2])):
                    last = self._add(last, ANY, must)
                for s in range(begin, last):
                    self.free[s].add(last)
            else:
                must += not optional
                last = self._add(last, ids.setdefault(part, len(ids)), must)
        self.end, self.must = last, must
        # optional words in front change neither acceptance nor the share: what follows them is found from its own start
        self.starts = {t for s in self._closure({0}) for t, n in self.step[s] if self.depth[n]}

    def _add(self, state: int, token: int, depth: int) -> int:
        self.step.append([])
        self.free.append(set())
        self.depth.append(depth)
        self.step[state].append((token, len(self.step) - 1))
        return len(self.step) - 1

    def _closure(self, states: set[int]) -> set[int]:
        found, left = set(states), list(states)
        while left:
            for s in self.free[left.pop()] - found:
                found.add(s)
                left.append(s)
        return found

    def run(self, tokens: list[int]) -> tuple[bool, float]:
        """Whether some beginning of ``tokens`` is accepted; the share of the mandatory words met on the way."""
        states, deepest = self._closure({0}), 0
        for token in tokens:
            if self.end in states:
                return True, 1.0
            states = self._closure({n for s in states for t, n in self.step[s] if t in (token, ANY)})
            if not states:
                break
            deepest = max(deepest, max(self.depth[s] for s in states))
        return (True, 1.0) if self.end in states else (False, deepest / max(1, self.must))


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        ids: dict[str, int] = {}
        self.automata = [Automaton(label, markup, ids) for label, markup in templates]
        self.phrases = [(label, [ids.setdefault(w, len(ids)) for w in phrase.split()]) for label, phrase in phrases]
        self.longest = max(len(a.step) for a in self.automata)
        words = sorted(ids, key=ids.__getitem__)
        text = np.frombuffer("".join(words).encode() + bytes(8), np.uint8)
        end = np.cumsum([len(w) for w in words])
        hashes = K.span_hashes(text, np.concatenate([[0], end[:-1]]), end)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.words = hashes[order], order, [w.encode() for w in words]
        # a template is tried wherever its first mandatory word stands
        self.begins: dict[int, list[Automaton]] = {}
        for a in self.automata:
            for t in a.starts:
                self.begins.setdefault(t, []).append(a)

    def tokens(self, words: K.Words) -> np.ndarray:
        """Each word's number among the templates' words, or -1."""
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], -1)

    def places(self, tokens: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str]]:
        """Word numbers in the chunk and labels of the phrases."""
        row_end = np.repeat(first[1:], np.diff(first))
        for label, phrase in self.phrases:
            n = len(phrase)
            at = np.flatnonzero(tokens == phrase[-1]) - (n - 1)
            for k, t in enumerate(phrase[:-1]):
                at = at[at >= 0]
                at = at[tokens[at + k] == t]
            for x in at[at + n <= row_end[at]].tolist() if len(at) else ():
                yield x, label

    def matches(self, tokens: list[int]) -> tuple[set[str], float]:
        """Labels of the templates that the row's words take to the end, and the best share of mandatory words met."""
        labels, best = set(), 0.0
        for k, t in enumerate(tokens):
            for a in self.begins.get(t, ()) if t >= 0 else ():
                if a.label not in labels:
                    ok, share = a.run(tokens[k : k + self.longest])
                    best = max(best, share)
                    if ok:
                        labels.add(a.label)
        return labels, best


_SCANNERS: list[Scanner] = []


def _matched(scanner: Scanner, first: np.ndarray, tokens: np.ndarray) -> dict[int, tuple[set[str], float]]:
    """Labels and share of each row in which a template could begin."""
    tried = np.searchsorted(first, np.flatnonzero(np.isin(tokens, sorted(scanner.begins))), "right") - 1
    return {r: scanner.matches(tokens[first[r] : first[r + 1]].tolist()) for r in set(tried.tolist())}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    scanner = _SCANNERS[0]
    for batch in batches:
        # of rows with marks beyond ASCII the method reads a text without them
        marked = np.flatnonzero(pc.match_substring_regex(batch["text"], MARKS).fill_null(False).to_numpy(zero_copy_only=False))
        read: dict[int, tuple[set[str], float]] = {}
        data, offsets = K.buffers(pc.replace_substring_regex(batch["text"].take(pa.array(marked)), MARKS, " "))
        for i, j in K.chunks(offsets):
            words = K.Words(data, offsets, i, j, APART)
            found = _matched(scanner, words.first, scanner.tokens(words))
            read |= {int(marked[i + r]): found.get(r, (set(), 0.0)) for r in range(j - i)}
        data, offsets = K.buffers(batch["text"])
        rows: list[tuple] = []
        for i, j in K.chunks(offsets):
            words = K.Words(data, offsets, i, j, APART)
            first, tokens = words.first, scanner.tokens(words)
            found: dict[int, list[tuple[int, str]]] = {}
            for x, label in scanner.places(tokens, first):
                r = int(np.searchsorted(first, x, "right")) - 1
                found.setdefault(r, []).append((x - int(first[r]), label))
            plain = _matched(scanner, first, tokens)
            for r in range(j - i):
                base = found.get(r, [])
                labels, score = read[i + r] if i + r in read else plain.get(r, (set(), 0.0))
                own = {label for _, label in base}
                at = [x for x, _ in base]
                rows.append((int(first[r + 1] - first[r]), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)), 1.0 if own else score))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row of ``docs``.

    Words are runs without ASCII characters other than digits and letters, A-Z lower-cased. ``n_base`` counts the places
    of the base phrases; ``score`` is 1 where a template or phrase is there, else the largest share of a template's
    mandatory words that stand in order at one place. Templates read typographic quotation marks, dashes and the like as blanks,
    base phrases as letters. A null text is empty, an empty text has no labels. Repeated rows each
    give a row, a null ``doc_id`` is a value like another, other columns are ignored.
    """
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
