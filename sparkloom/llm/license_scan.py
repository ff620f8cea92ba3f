"""License scan by conditional compression.

Around each word of licensing a text is searched as far as the longest template reaches, over line ends. A run of words
is a candidate for a template if it has at least `similarity` of the template's words in order (longest common
subsequence, bit-parallel) and is at most 1 / similarity times as long. Candidates are ranked by the bytes that they
shrink when compressed with their template as a raw zstandard dictionary instead of plain; one that shrinks by none or
less is no candidate. In that order they are confirmed by their exact differences: words of the template that the text
lacks, words in between that it adds. A difference in a word that names a license or its version (a name, BY, SA, NC,
ND, a number) rejects, so a license without a template is not taken for one with a similar wording. Confirmed ones that
overlap no better one are reported with the differences and the place of their words.

Null and empty texts state nothing; equal savings go to the name that comes first; a text may state several licenses, or
one in several places, and time grows with their number. A copy that lacks all words of licensing is not looked for.
Repeated rows and rows without a doc_id are scanned like others; very long texts are scanned one at a time. Other
columns are not read. The share saved is that of the words around the statement, 60 before and 180 from its start on.
"""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import small_batches, text_blocks

SCHEMA = "doc_id long, start long, end long, license string, saved double, n_missing int, n_added int, differences string"

CUE = re.compile(r"licen[sc]|copyright|spdx|warrant|redistribut|permission|all\s+rights\s+reserved|public\s+domain|unencumbered", re.I)
WORD = re.compile(r"[\w.+-]*\w")

# Statements and notices as their publishers word them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT statement": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD statement": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 statement": "Licensed under CC BY 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


# Words, or parts of compounds, by which licenses differ.
NAMES = frozenset(
    "mit isc bsd apache gpl lgpl agpl gnu lesser library affero mozilla mpl eclipse epl creative commons cc cc0 by sa nc nd attribution sharealike noncommercial noderivs noderivatives public domain"
    " unlicense zlib boost artistic proprietary".split()
)
NUMBER = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")


def names_license(word: str) -> bool:
    return any(p in NAMES for p in word.split("-")) or NUMBER.fullmatch(word) is not None


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def blocks_of(text: str, reach: int) -> list[tuple[int, int]]:
    """Character spans that go reach characters beyond words of licensing, to the next white space; joined where they meet."""
    spans: list[tuple[int, int]] = []
    for m in CUE.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        out.append((a, b) if not out or a > out[-1][1] else (out.pop()[0], b))
    return out


class Matcher:
    def __init__(self, templates: dict[str, str], similarity: float):
        import zstandard as z

        self.plain = z.ZstdCompressor(level=3)
        self.similarity = similarity
        self.templates = []
        for name, text in sorted(templates.items()):
            folded = " ".join(words_of(text))
            if folded:
                given = z.ZstdCompressionDict(folded.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
                self.templates.append((name, folded.split(), z.ZstdCompressor(level=3, dict_data=given)))
        #: Characters that the longest near copy may have, with marks of comments on each line.
        self.reach = int(1.3 / similarity * max(map(len, templates.values()), default=0))

    def saved(self, words: list[str], compressor) -> tuple[int, float]:
        """Bytes that a template saves of the words, and their share."""
        data = " ".join(words).encode()
        plain = len(self.plain.compress(data))
        left = len(compressor.compress(data))
        return plain - left, 1 - left / plain

    def places(self, words: list[str], template: list[str]) -> list[tuple[int, int]]:
        """Runs of words that hold the template, or nearly; of overlapping ones that with the fewest differences."""
        m, masks = len(template), {}
        for i, w in enumerate(template):
            masks[w] = masks.get(w, 0) | 1 << i
        need, longest, full = math.ceil(self.similarity * m), int(m / self.similarity), (1 << m) - 1
        held = [0, *accumulate(w in masks for w in words)]
        if held[-1] < need:
            return []
        fits = []
        for s, w in enumerate(words):
            stop = min(len(words), s + longest)
            if w not in masks or held[stop] - held[s] < need:
                continue
            rows, best = full, None  # a zero bit for each word of the longest common subsequence
            for e in range(s, stop):
                both = rows & masks.get(words[e], 0)
                rows = (rows + both | rows - both) & full
                common = m - rows.bit_count()
                if common >= need and (best is None or m + e + 1 - s - 2 * common < best[0]):
                    best = m + e + 1 - s - 2 * common, s, e + 1
            if best:
                fits.append(best)
        taken, covered = [], bytearray(len(words))
        for _, s, e in sorted(fits):
            if not any(covered[s:e]):
                taken.append((s, e))
                covered[s:e] = b"\1" * (e - s)
        return taken

    @staticmethod
    def differences(words: list[str], template: list[str]) -> tuple[list[str], int, int, bool]:
        """(differences, missing, added, whether one of them names a license). Numbers count where the template has any."""
        diff, missing, added, other = [], 0, 0, False
        numbered = any(NUMBER.fullmatch(w) for w in template)
        for kind, a, b, c, d in SequenceMatcher(None, words, template, autojunk=False).get_opcodes():
            if kind != "equal":
                diff.append(f"-{' '.join(template[c:d])}+{' '.join(words[a:b])}")
                missing, added = missing + d - c, added + b - a
                other = other or any(names_license(w) and (numbered or not NUMBER.fullmatch(w)) for w in template[c:d] + words[a:b])
        return diff, missing, added, other

    def find(self, text: str, reach: int = 60) -> list[tuple]:
        """(name, share saved, first word, end, differences, missing, added) of each license stated in the text."""
        words = words_of(text)
        ranked = []
        for name, template, compressor in self.templates:
            for s, e in self.places(words, template):
                if (saved := self.saved(words[s:e], compressor)[0]) >= 0:
                    ranked.append((-saved, name, s, e, template, compressor))
        found, covered = [], bytearray(len(words))
        for _, name, s, e, template, compressor in sorted(ranked, key=lambda x: x[:4]):
            if any(covered[s:e]):
                continue
            *differences, other = self.differences(words[s:e], template)
            if not other:
                covered[s:e] = b"\1" * (e - s)
                found.append((name, self.saved(words[max(0, s - reach) : s + 3 * reach], compressor)[1], s, e, *differences))
        return found

    def statements(self, text: str) -> list[tuple]:
        """(first character, end, name, share saved, differences, missing, added) of each license stated in a whole text."""
        out = []
        for a, b in blocks_of(text, self.reach):
            at = [m.span() for m in WORD.finditer(text, a, b)]
            out += [(at[s][0], at[e - 1][1], name, saved, *rest) for name, saved, s, e, *rest in self.find(text[a:b])]
        return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, similarity: float = 0.8) -> DataFrame:
    """One row for each license stated in docs (doc_id, text): its place, the share saved, the wording differences."""
    small_batches(docs.sparkSession)
    templates = templates or TEMPLATES

    def run(batches):
        matcher = Matcher(templates, similarity)
        kinds = (*(pa.int64(),) * 3, pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
        for ids, texts in text_blocks(batches, "doc_id", "text"):
            rows = []
            for doc_id, text in zip(ids, texts):
                for a, b, name, saved, diff, missing, added in matcher.statements(text) if text else ():
                    rows.append((doc_id, a, b, name, round(saved, 6), missing, added, "; ".join(diff)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 8, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
