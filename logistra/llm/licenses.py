"""License scans: windows of texts against licence templates.

Texts are normalised to lower-case words of letters and digits. Wherever bigrams of a
template lie close enough together, the windows around them, of up to the template's
size times what the threshold allows, are compared with it by the Dice coefficient of their
distinct word bigrams. The bounds that a match puts on the number of common bigrams
and on the window's size prune the other templates and places, so lines, paragraphs
and the length of the text do not matter.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logistra.llm import tokens
from logistra.llm.frames import pick

# Least Dice coefficient of a match.
THRESHOLD = 0.8

# Notices by which common licences are named or granted, and texts of short ones.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"
        " except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
        " in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License"
        " for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons"
        " to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the Software.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International"
        " License.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International"
        " License.",
    ),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of"
        " the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of"
        " the GNU General Public License as published by the Free Software Foundation; either"
        " version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MIT",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING"
        " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
        " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
        " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING"
        " FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met: 1. Redistributions of source"
        " code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,"
        " this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to"
        " endorse or promote products derived from this software without specific prior written"
        " permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event"
        " will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including"
        " commercial applications, and to alter it and redistribute it freely",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to"
        " copy, modify, publish, use, compile, sell, or distribute this software, either in source"
        " code form or as a compiled binary, for any purpose, commercial or non-commercial, and by"
        " any means.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Proprietary", "All rights reserved."),
)

SCHEMA = "doc_id {id}, line long, lines long, license string, template int, dice double"


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    """Distinct bigrams; one word alone stands for itself."""
    return np.unique(tokens.shingles(hashes, 2))


class Match(NamedTuple):
    """A window that reaches the threshold: its document, template, words and coefficient."""

    doc: int
    template: int
    first: int
    end: int
    common: int
    dice: float


class Matcher:
    """Templates as one sorted list of bigrams."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold is above 0 and at most 1")
        self.names = [name for name, _ in templates]
        self.threshold = threshold
        self.table = tokens.byte_table(letters_only=True)
        texts = pa.array([text for _, text in templates], pa.string())
        words = [
            w.hashes[i:j]
            for w in tokens.words(texts, self.table)
            for i, j in zip(w.offsets[:-1], w.offsets[1:], strict=True)
        ]
        sets = [_bigrams(h) for h in words]
        self.sets = [frozenset(s.tolist()) for s in sets]
        # A window of n bigrams, c of them among a template's s, matches if 2 c >= threshold (s + n).
        # As c <= n and c <= s, at least so many are common, and the window has at most so many.
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.least = np.ceil(sizes * threshold / (2 - threshold) - 1e-9).astype(np.int64)
        self.most = np.floor(sizes * (2 - threshold) / threshold + 1e-9).astype(np.int64)
        self.single = np.array([len(h) == 1 for h in words], dtype=bool)
        values = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).astype(np.uint64)
        owners = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def _hits(self, w: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(templates, places, documents) of template bigrams in a chunk, by template, then place."""
        pairs = tokens.shingles(w.hashes, 2) if len(w.hashes) > 1 else w.hashes[:0]
        inside = np.ones(len(pairs), dtype=bool)
        # The last word of a document and the first of the next are no bigram.
        ends = w.offsets[1:-1] - 1
        inside[ends[(ends >= 0) & (ends < len(pairs))]] = False
        found, parts = [], [(pairs, np.flatnonzero(_among(pairs, self.values) & inside), False)]
        if self.single.any():
            alone = tokens.alone(w.hashes)
            parts.append((alone, np.flatnonzero(_among(alone, self.values)), True))
        for codes, at, single in parts:
            i, j = (np.searchsorted(self.values, codes[at], side=side) for side in ("left", "right"))
            n = j - i
            place = np.repeat(at, n)
            owner = self.owners[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(i, n)]
            mine = self.single[owner] == single
            found.append((owner[mine], place[mine]))
        owner, place = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        return owner, place, np.searchsorted(w.offsets, place, side="right") - 1

    def windows(self, w: tokens.Words) -> list[Match]:
        """Of every place where a template may begin the window with the largest coefficient, if that matches."""
        if len(w.hashes) == 0 or len(self.values) == 0:
            return []
        owner, place, docs = self._hits(w)
        out: list[Match] = []
        for t in np.unique(owner):
            a, b = np.searchsorted(owner, [t, t + 1])
            at, of, least = place[a:b], docs[a:b], int(self.least[t])
            if self.single[t]:
                out += [Match(int(d), int(t), int(p), int(p) + 1, 1, 1.0) for d, p in zip(of, at, strict=True)]
                continue
            if len(at) < least:
                continue
            last = np.arange(len(at) - least + 1) + least - 1
            near = (at[last] - at[: len(last)] < self.most[t]) & (of[last] == of[: len(last)])
            # A window that could begin with the bigram before is no worse for it.
            follows = np.append(False, (at[1:] == at[:-1] + 1) & (of[1:] == of[:-1]))[: len(near)]
            follows[1:] &= near[:-1]
            for p, d in zip(at[: len(last)][near & ~follows].tolist(), of[: len(last)][near & ~follows].tolist()):
                end = min(p + int(self.most[t]), int(w.offsets[d + 1]) - 1)
                codes = tokens.shingles(w.hashes[p : end + 1], 2).tolist()
                if best := self._best(codes, self.sets[t]):
                    dice, common, size = best
                    out.append(Match(d, int(t), p, p + size + 1, common, dice))
        return out

    def _best(self, codes: list[int], template: frozenset) -> tuple[float, int, int] | None:
        """(coefficient, common bigrams, bigrams) of the best window that begins where ``codes`` do."""
        seen: set[int] = set()
        common, best = 0, (0.0, 0, 0)
        for size, code in enumerate(codes, 1):
            if code in seen:
                continue
            seen.add(code)
            if code in template:
                common += 1
                dice = 2 * common / (len(template) + len(seen))
                if dice > best[0]:
                    best = dice, common, size
        return best if best[0] >= self.threshold - 1e-12 else None

    def matches(self, w: tokens.Words) -> list[Match]:
        """Windows that do not overlap: those with more common bigrams first, then by coefficient, template, place."""
        kept: list[Match] = []
        by_doc: dict[int, list[Match]] = {}
        for found in self.windows(w):
            by_doc.setdefault(found.doc, []).append(found)
        for _, found in sorted(by_doc.items()):
            chosen: list[Match] = []
            for m in sorted(found, key=lambda m: (-m.common, -m.dice, m.template, m.first)):
                place = bisect([c.first for c in chosen], m.first)
                before = place == 0 or chosen[place - 1].end <= m.first
                if before and (place == len(chosen) or chosen[place].first >= m.end):
                    chosen.insert(place, m)
            kept += chosen
        return kept


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per matching window of ``docs`` (doc_id, text).

    ``line`` is the number of the line, from 0, in which the window begins, ``lines`` the
    number of lines it reaches over, ``template`` the number of the template and
    ``dice`` the coefficient. Of overlapping windows that with most common bigrams
    stays, of equals that of the first template. A window may begin and end anywhere, also
    amid a line, and has at most (2 - threshold) / threshold times the template's bigrams.
    Null, empty and wordless texts have none; rows with equal ids are scanned each;
    an empty table, or no template, gives none.
    """
    texts = pick(docs, "doc_id", "text")
    matcher = Matcher(templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for w in tokens.words(batch.column("text"), matcher.table):
                for m in matcher.matches(w):
                    lo = w.bounds[m.doc]
                    breaks = np.flatnonzero(w.raw[lo : w.starts[m.end - 1]] == 10) + lo
                    line, last = np.searchsorted(breaks, w.starts[[m.first, m.end - 1]]).tolist()
                    rows.append((w.first + m.doc, line, last - line + 1, m.template, m.dice))
            at, line, lines, template, dice = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(line, pa.int64()),
                    pa.array(lines, pa.int64()),
                    pa.array([matcher.names[t] for t in template], pa.string()),
                    pa.array(template, pa.int32()),
                    pa.array(dice, pa.float64()),
                ],
                names=["doc_id", "line", "lines", "license", "template", "dice"],
            )

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, SCHEMA.format(id=id_type))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is known; most are told apart by 16 bits."""
    seen = np.zeros(1 << 16, dtype=bool)
    seen[known >> np.uint64(48)] = True
    out = seen[values >> np.uint64(48)]
    out[out] = np.isin(values[out], known)
    return out
