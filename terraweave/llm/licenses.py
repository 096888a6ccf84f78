"""License scans by patience alignment.

A text and a license template are aligned as sequences of words: words that occur once in each are anchors, the longest
increasing subsequence of anchors is kept, and the gaps between them are aligned in the same way, those without anchors
by longest common subsequence. The share of the template's words that find their place is the coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+")

#: Wordings of license notices as their publishers give them.
TEMPLATES = {
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-line": "Released under the BSD License.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-line": "Released under the ISC License.",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Words by which a template differs from those of other licenses: they have to stand in a text as they are, in one piece.
NAMES = {
    "agpl-3.0-line": ("gnu affero general public license version 3",),
    "agpl-3.0-notice": ("gnu affero general public license", "version 3"),
    "apache-2.0-line": ("apache license version 2 0",),
    "apache-2.0-notice": ("apache license version 2 0",),
    "bsd-line": ("bsd license",),
    "cc-by-4.0-line": ("cc by 4 0",),
    "cc-by-nc-4.0-line": ("cc by nc 4 0",),
    "cc-by-nc-nd-4.0-line": ("cc by nc nd 4 0",),
    "cc-by-nc-sa-4.0-line": ("cc by nc sa 4 0",),
    "cc-by-nd-4.0-line": ("cc by nd 4 0",),
    "cc-by-sa-4.0-line": ("cc by sa 4 0",),
    "gpl-2.0-line": ("gnu general public license version 2",),
    "gpl-2.0-notice": ("gnu general public license", "version 2"),
    "gpl-3.0-line": ("gnu general public license version 3",),
    "gpl-3.0-notice": ("gnu general public license", "version 3"),
    "isc-line": ("isc license",),
    "lgpl-2.1-line": ("gnu lesser general public license version 2 1",),
    "lgpl-2.1-notice": ("gnu lesser general public license", "version 2 1"),
    "lgpl-3.0-line": ("gnu lesser general public license version 3",),
    "lgpl-3.0-notice": ("gnu lesser general public license", "version 3"),
    "mit-line": ("mit license",),
    "mpl-2.0-line": ("mozilla public license version 2 0",),
    "mpl-2.0-notice": ("mozilla public license v 2 0",),
}
#: Reported where a template covers a place but its name does not stand there.
UNKNOWN = "unknown-variant"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first number, whose second numbers increase."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [k]
        back.append(ends[at - 1] if at else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        once_a, once_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        at = {w: j for j, w in enumerate(b[j0:j1], j0) if once_b[w] == 1}
        anchors = increasing([(i, at[w]) for i, w in enumerate(a[i0:i1], i0) if once_a[w] == 1 and w in at])
        if not anchors:
            out += [(i0 + i, j0 + j) for i, j in common_subsequence(a[i0:i1], b[j0:j1])]
            continue
        out += anchors
        edges = [(i0 - 1, j0 - 1), *anchors, (i1, j1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def tight(window: list[str], template: list[str]) -> list[tuple[int, int]]:
    """align(), moved as near to its end as it goes without a loss: words before a place may stand for its first ones."""
    pairs = align(window, template)
    if not pairs:
        return pairs
    end = pairs[-1][0] + 1
    late = [(end - 1 - i, len(template) - 1 - j) for i, j in align(window[:end][::-1], template[::-1])][::-1]
    return late if len(late) >= len(pairs) else pairs


class Scanner:
    """Cues of a template are its words that are rarest over all templates, so many that they stand at more of its places
    than may be missing: a text with `least` of the template has one of them at a place of the template."""

    def __init__(self, templates: dict[str, str], least: float = COVERAGE):
        self.least = least
        self.names: dict[str, list[range]] = {}
        self.words = {name: words_of(t) for name, t in sorted(templates.items()) if words_of(t)}
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        for name, words in self.words.items():
            for phrase in (p.split() for p in NAMES.get(name, ()) if templates[name] == TEMPLATES[name]):
                at = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
                self.names.setdefault(name, []).append(range(at, at + len(phrase)))
        spread = Counter(w for words in self.words.values() for w in set(words))
        self.cues: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            missing = sum(1 for n in range(len(words)) if n >= least * len(words))
            for w in sorted(set(words), key=lambda w: (spread[w], words.count(w), -len(w), w)):
                at = [k for k, x in enumerate(words) if x == w]
                self.cues[w] += [(name, k) for k in at]
                missing -= len(at)
                if missing < 0:
                    break

    def named(self, name: str, pairs: list[tuple[int, int]]) -> bool:
        """Whether the words of a template's name are matched, with no other word between them."""
        at = {j: i for i, j in pairs}
        return all(at.get(j) is not None and at[j] == at.get(span[0], -1) + j - span[0] for span in self.names.get(name, ()) for j in span)

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """(template, first word, word after the last, words matched, coverage) of each place with enough coverage.

        A template is tried where each of its cues puts it, alone and with half its length to spare before, after and on
        both sides; of places that overlap the one with most words matched stays, then one whose name is there, that of the
        higher coverage, the shorter, the first. A place without the name of its template is an UNKNOWN one.
        """
        words, least = words_of(text), self.least
        tries: dict[str, set[int]] = defaultdict(set)
        for p, w in enumerate(words):
            for name, at in self.cues.get(w, ()):
                tries[name].add(p - at)
        found = set()
        for name, starts in tries.items():
            template, counts = self.words[name], self.counts[name]
            spare = len(template) // 2 + 2
            own = list(accumulate((w in counts for w in words), initial=0))
            done = set()
            for s in sorted(starts):
                for before, after in ((spare, spare), (0, 0), (spare, 0), (0, spare)):
                    low, high = max(0, s - before), min(len(words), s + len(template) + after)
                    enough = high > low and own[high] - own[low] >= least * len(template)
                    if not enough or sum((Counter(words[low:high]) & counts).values()) < least * len(template):
                        if before and after:
                            break  # the other windows are parts of this one
                        continue
                    if (low, high) in done:
                        continue
                    done.add((low, high))
                    pairs = tight(words[low:high], template)
                    if len(pairs) >= least * len(template):
                        found.add((name if self.named(name, pairs) else UNKNOWN, low + pairs[0][0], low + pairs[-1][0] + 1, len(pairs), len(pairs) / len(template)))
        out: list[tuple[str, int, int, int, float]] = []
        for hit in sorted(found, key=lambda f: (-f[3], f[0] == UNKNOWN, -f[4], f[2] - f[1], f[1], f[0])):
            if all(hit[2] <= x[1] or hit[1] >= x[2] for x in out):
                out.append(hit)
        return sorted(out, key=lambda f: f[1])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """(doc_id, license, first_word, end_word, n_matched, coverage): every place of docs(doc_id, text) where a template is
    covered by `least` or more.

    Null, empty and blank texts have no places; repeated rows give repeated places; a null doc_id is carried along. An
    empty table gives an empty result; other columns are ignored. Equal words are told apart by place alone.
    """
    scanner = Scanner(templates or TEMPLATES, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in scanner.scan(text.as_py())]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "license", "first_word", "end_word", "n_matched", "coverage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, first_word long, end_word long, n_matched long, coverage double")
