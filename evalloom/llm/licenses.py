"""Licence scan: Dice coefficient over word bigrams against templates.

A text's lines, its blocks between blank lines and the whole of it are compared. Words are runs of ASCII
letters and digits in lower case; bigrams count as often as they occur. Two sizes m and n can reach a Dice
coefficient t only if 2 min(m, n) >= t (m + n), which bounds the templates that a unit is compared with; an
index from bigrams to templates leaves only those that share one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evalloom.llm.common import docs_of, ids_of, sliced, tables

#: Notices by which texts name their licence, and the bodies of short licences.
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-3.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
DICE = 0.8
WORD = re.compile(rb"[a-z0-9]+")
BLANK = re.compile(rb"\n[ \t\r\x0b\x0c]*\n")


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, str], dice: float) -> None:
        self._dice = dice
        self._grams = {k: Counter(zip(w, w[1:])) for k, t in sorted(templates.items()) if len(w := words(t.encode())) > 1}
        self._size = {k: sum(c.values()) for k, c in self._grams.items()}
        self._of: dict[tuple, list[str]] = {}
        for k, c in self._grams.items():
            for g in c:
                self._of.setdefault(g, []).append(k)
        self._most = max((n * (2 - dice) / dice for n in self._size.values()), default=0)

    def match(self, w: list[bytes]) -> list[tuple[str, float]]:
        n = len(w) - 1
        if n < 1 or n > self._most:
            return []
        grams = list(zip(w, w[1:]))
        some = {k for g in grams for k in self._of.get(g, ())}
        if not some:
            return []
        mine, out = Counter(grams), []
        for k in sorted(some):
            m = self._size[k]
            if 2 * min(m, n) < self._dice * (m + n):
                continue
            got = 2 * sum(min(c, mine[g]) for g, c in self._grams[k].items()) / (m + n)
            if got >= self._dice:
                out.append((k, got))
        return out

    def scan(self, text: bytes) -> Iterator[tuple[str, int, str, float]]:
        """(kind of unit, its number, licence, dice)."""
        lines = [words(x) for x in text.split(b"\n")]
        for i, w in enumerate(lines):
            for k, d in self.match(w):
                yield "line", i, k, d
        blocks = BLANK.split(text)
        if len(blocks) > 1:
            for i, x in enumerate(blocks):
                for k, d in self.match(words(x)):
                    yield "block", i, k, d
        if len(lines) > 1 and sum(map(len, lines)) - 1 <= self._most:
            for k, d in self.match([w for ws in lines for w in ws]):
                yield "text", 0, k, d


    def windows(self, text: bytes) -> Iterator[tuple[str, int, str, float]]:
        """("window", its first word, licence, dice): runs of words anywhere in the text, the best of those that overlap.

        The best window begins and ends with a bigram of the template; all such within the size bounds are tried,
        where enough of the template's bigrams lie close enough together.
        """
        w = words(text)
        grams = list(zip(w, w[1:]))
        at: dict[str, list[int]] = {}
        for i, g in enumerate(grams):
            for k in self._of.get(g, ()):
                at.setdefault(k, []).append(i)
        for k, places in sorted(at.items()):
            m, most, found = self._size[k], self._size[k] * (2 - self._dice) / self._dice, []
            need = max(1, math.ceil(self._dice * m / (2 - self._dice) - 1e-9))
            for a, i in enumerate(places):
                if a + need > len(places) or places[a + need - 1] - i + 1 > most:
                    continue
                left, both = dict(self._grams[k]), 0
                for j in places[a:]:
                    if j - i + 1 > most:
                        break
                    if left[grams[j]]:
                        left[grams[j]] -= 1
                        both += 1
                        got = 2 * both / (m + j - i + 1)
                        if got >= self._dice:
                            found.append((-got, i, j))
            taken: list[tuple[int, int]] = []
            for got, i, j in sorted(found):
                if all(j < x or i > y for x, y in taken):
                    taken.append((i, j))
                    yield "window", i, k, -got


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE, windows: bool = False) -> DataFrame:
    """One row per unit and template that reach dice: doc_id, unit, unit_no, license_id, dice (6 decimals).

    unit: line, block (texts with blank lines) or text (texts of several lines); with windows also window, a run of
    words anywhere in the text, whose number is that of its first word. A null or empty text has no
    row; a unit of one word has no bigram and no row. All templates that reach dice are told, ties included.
    Rows without an id are left out; rows that repeat an id each have their rows.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, dice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            rows = [(i, *hit) for i, t in zip(ids_of(b).tolist(), texts, strict=True) for hit in chain(scanner.scan(t), scanner.windows(t) if windows else ())]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64())
            cols = [pa.array([round(r[4], 6) if j == 4 else r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "unit", "unit_no", "license_id", "dice"])

    return docs_of(df).mapInArrow(run, "doc_id long, unit string, unit_no long, license_id string, dice double")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(tables(spark, sf_dir, "documents"))


def op8_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op8_licenses, and notices inside longer units."""
    return scan_licenses(tables(spark, sf_dir, "documents"), windows=True)


OP8_SQL = f"""
WITH templates(license_id, template) AS (VALUES {", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES.items())}),
docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines, regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r\\x0b\\x0c]*\\n') AS blocks FROM documents WHERE doc_id IS NOT NULL),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(lines))) AS unit_no, unnest(lines) AS part FROM docs
  UNION ALL SELECT doc_id, 'block', unnest(range(len(blocks))), unnest(blocks) FROM docs WHERE len(blocks) > 1
  UNION ALL SELECT doc_id, 'text', 0, text FROM docs WHERE len(lines) > 1
),
u AS (SELECT doc_id, unit, unit_no, regexp_extract_all(lower(part), '[a-z0-9]+') AS w FROM units),
t AS (SELECT license_id, regexp_extract_all(lower(template), '[a-z0-9]+') AS w FROM templates),
ug AS (SELECT doc_id, unit, unit_no, len(w) - 1 AS n, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM u WHERE len(w) > 1),
tg AS (SELECT license_id, len(w) - 1 AS m, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM t WHERE len(w) > 1),
uc AS (SELECT doc_id, unit, unit_no, n, g, count(*) AS c FROM ug GROUP BY ALL),
tc AS (SELECT license_id, m, g, count(*) AS c FROM tg GROUP BY ALL)
SELECT doc_id, unit, CAST(unit_no AS BIGINT) AS unit_no, license_id, round(2.0 * sum(least(uc.c, tc.c)) / (m + n), 6) AS dice
FROM uc JOIN tc USING (g) GROUP BY doc_id, unit, unit_no, license_id, m, n
HAVING 2.0 * sum(least(uc.c, tc.c)) / (m + n) >= {DICE}
"""
