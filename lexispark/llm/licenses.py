"""License scans by conditional compression.

Candidate places: a template of n words may lack d = MAX_DIFFERENT * n words (rounded down) of its own and hold d others
between its first and last. So of any 2d + 1 pieces that it is cut into, one stands unchanged in the text; every place where
a piece stands is looked at, whatever the lines' ends (notices are wrapped) and however long the text. There the words (case,
punctuation and white space aside) are compared by their longest common subsequence over all stretches that can fit.
A stretch's words are compressed with those of the template as a zstandard raw dictionary, and saved is what the template saves over
compression without dictionary, per byte of the stretch: a template that saves nothing gives no finding, and of overlapping stretches
the one whose template saves most wins (of equal ones the longest template, then the fewest differences, then by name); all the others
are reported. Only a stretch inside that of a template which holds its own template whole is part of that notice before. block is the
number of the first line. All texts are read, whatever words they hold.

Every text is worked on where it is, so a license that a third of all rows hold gathers nowhere, and no row needs an id. Nulls
and empty texts have no findings. Repeated rows have equal findings, each its own. `findings` keeps the columns of docs, whatever
their names, and replaces a column of its own name; `scan` gives a row per finding. An empty table gives an empty result."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights under the CC0 1.0 Universal license.",
}
MAX_DIFFERENT = 0.1
WORD = re.compile(r"\w+(?:[.-]\w+)*")
FINDINGS = "block int, license string, saved double, n_different int, n_extra int, exact boolean"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    """The templates, made ready to compare and to compress with."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.words = {k: words(t) for k, t in templates.items()}
        self.allowed = {k: int(MAX_DIFFERENT * len(w)) for k, w in self.words.items()}
        self.bits = {k: {w: sum(1 << i for i, x in enumerate(ws) if x == w) for w in ws} for k, ws in self.words.items()}
        #: By its rarest (here: longest) word, each piece: (template, place of the piece in it, words, place of the word in it).
        self.pieces: dict[str, list[tuple[str, int, list[str], int]]] = {}
        for k, ws in self.words.items():
            n = 2 * self.allowed[k] + 1
            for i in range(n):
                a, b = len(ws) * i // n, len(ws) * (i + 1) // n
                rare = max(range(a, b), key=lambda j: len(ws[j]))
                self.pieces.setdefault(ws[rare], []).append((k, a, ws[a:b], rare - a))
        padded = {k: f" {' '.join(w)} " for k, w in self.words.items()}
        parts = {k: {x for x in padded if x != k and padded[x] in padded[k]} for k in padded}
        #: Templates that hold others word by word, and which.
        self.wholes = {k: x for k, x in parts.items() if x}
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.coders = {}
        for k, ws in self.words.items():
            held = zstandard.ZstdCompressionDict(" ".join(ws).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=9)
            self.coders[k] = zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_dict_id=False)

    def saved(self, stretch: list[str], name: str) -> float:
        data = " ".join(stretch).encode("utf-8", "replace")
        return (len(self.plain.compress(data)) - len(self.coders[name].compress(data))) / len(data)

    def places(self, own: list[str]) -> dict[str, set[int]]:
        """Per template, where it would begin in own, going by the pieces that stand there."""
        found: dict[str, set[int]] = {}
        for i, w in enumerate(own):
            for name, a, piece, at in self.pieces.get(w, ()):
                if i >= at and own[i - at : i - at + len(piece)] == piece:
                    found.setdefault(name, set()).add(i - at - a)
        return found

    def fits(self, own: list[str], name: str, place: int) -> list[tuple[int, int, int, int]]:
        """(differences, first word, end, words lacking) of the best stretch that begins near place, if one is near enough."""
        wanted, allowed, bits = self.words[name], self.allowed[name], self.bits[name]
        n, best = len(wanted), None
        if place >= 0 and own[place : place + n] == wanted:
            return [(0, place, place + n, 0)]
        if not allowed:
            return []
        for a in range(max(0, place - allowed), place + allowed + 1):
            if a >= len(own) or own[a] not in bits:
                continue
            rows = all_ = (1 << n) - 1
            for b in range(a, min(len(own), a + n + allowed)):
                hit = rows & bits.get(own[b], 0)
                rows = (rows + hit | rows - hit) & all_
                lacks = rows.bit_count()
                extra = b + 1 - a - (n - lacks)
                if extra > allowed:
                    break
                if lacks <= allowed and (best is None or (lacks + extra, a, b + 1) < best[:3]):
                    best = lacks + extra, a, b + 1, lacks
        return [best] if best else []

    def scan(self, text: str) -> list[tuple[int, str, float, int, int]]:
        """(line, template, saved, words lacking, words extra) of the notices in text, in order."""
        lower = text.lower()
        own = WORD.findall(lower)
        if self.pieces.keys().isdisjoint(own):
            return []
        spans = [m.span() for m in WORD.finditer(lower)]
        fitting = {(f, name) for name, places in self.places(own).items() for place in places for f in self.fits(own, name, place)}
        if not fitting:
            return []
        whole = sorted((a, b, name) for (_, a, b, _), name in fitting if name in self.wholes)
        reach = 2 * max(map(len, self.words.values()))

        def part(a: int, b: int, name: str) -> bool:
            near = whole[bisect.bisect_left(whole, (a - reach,)) : bisect.bisect_left(whole, (a + 1,))]
            return any(name in self.wholes[k] and b <= y for _, y, k in near)

        fitting = {x for x in fitting if not part(*x[0][1:3], x[1])}
        ends = [m.start() for m in re.finditer("\n", lower)]
        ranked = []
        for (different, a, b, lacks), name in fitting:
            saved = self.saved(own[a:b], name)
            if saved > 0:
                ranked.append((-saved, -len(self.words[name]), different, name, a, b, lacks, bisect.bisect_left(ends, spans[a][0])))
        taken: list[tuple[int, int]] = []
        found = []
        for saved, _, different, name, a, b, lacks, first in sorted(ranked):
            i = bisect.bisect_left(taken, (a, b))
            if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
                continue
            taken.insert(i, (a, b))
            found.append((a, (first, name, -saved, lacks, different - lacks)))
        return [f for _, f in sorted(found)]


def _scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    scanner = Scanner()
    names = [x.split()[0] for x in FINDINGS.split(", ")]
    for texts in batches:
        yield pd.Series([[dict(zip(names, (*f, f[3] + f[4] == 0), strict=True)) for f in scanner.scan(t)] if isinstance(t, str) and t else [] for t in texts], dtype=object)


def findings(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with findings, an array of structs in the order of the text."""
    element = FINDINGS.replace(", ", ",").replace(" ", ":")
    return docs.withColumn("findings", F.pandas_udf(_scanned, f"array<struct<{element}>>")("text"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, block, license, saved, n_different, n_extra, exact) of docs(doc_id, text)."""
    return findings(docs.select("doc_id", "text")).select("doc_id", F.inline("findings"))
