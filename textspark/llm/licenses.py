"""License scans: winnowed fingerprints pick candidates, banded alignment reports matches.

Templates (notices, headers and whole texts of licenses) are cut into words; every
``gram`` words are hashed, and of each ``window`` neighbouring hashes the smallest is
kept (``SIZES``: shorter ones for templates below ``LONG`` words).  The kept hashes are
an inverted index from hash to (template, place).  A text's hashes are looked up there;
hits that lie near one diagonal of a template make a candidate.  A local alignment in a
band around the diagonal finds the best matching stretch, and again the best ones left
and right of it until none is long enough, so that copies close to each other are all
found.  A stretch is reported, with its coverage of the template and its span, if it
matches ``LEAST`` words, or four fifths of a template with fewer than that.  A copy of
gram + window - 1 unchanged words always makes a candidate.

The templates go to the tasks with the function (some tens of kilobytes; more can be
read from a folder by ``read_templates``); nothing is shuffled.  Of overlapping matches
the one with more matched words is kept (ties: earlier template).

Defined results: null and empty texts have no match; repeated rows are scanned
each for itself; other columns stay, but one with the name of the new one is replaced;
an empty table gives an empty one; texts are scanned whole, at any length.  Only A-Z are
lower-cased, so places count code points of the text as it is.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textspark.llm.common import map_batches

#: (gram, window) of templates below ``LONG`` words and of the others.
SIZES, LONG = ((3, 3), (5, 4)), 40
BAND, LEAST = 12, 15
WORD = re.compile(r"[a-z0-9]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: Texts of public licenses.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'

TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-text": _MIT,
    "mit-full": f"{_MIT} {_AS_IS}",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd-2-clause": f"{_BSD} {_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}",
    "isc": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "0bsd": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Whole license texts from the files of a folder, by file name; for ``scan(templates=TEMPLATES | ...)``."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("name"), "value")
    return {r["name"]: r["value"] for r in rows.orderBy("name").collect()}


def _hash(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring word hashes."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ words[i : len(words) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, w: int) -> list[int]:
    """Places of the smallest hash of each w neighbours (the last of equal ones)."""
    if not len(hashes):
        return []
    w = min(w, len(hashes))
    return sorted({i + w - 1 - int(np.argmin(hashes[i : i + w][::-1])) for i in range(len(hashes) - w + 1)})


#: A cell of the alignment is one number: score, then matched words, then how early it begins.
_SCORE, _MATCHED, _FAR = 40, 20, (1 << 20) - 1


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment near ``text place - template place = diagonal``: matched words, begin and end in the text.

    A matched word counts 2, one that differs or has no partner -1.
    """
    wide, one = 2 * band + 1, 1 << _SCORE
    offsets = np.arange(wide, dtype=np.int64)
    rows = np.arange(len(template))[:, None] + offsets + (diagonal - band)  # the text place of each cell
    inside = (rows >= 0) & (rows < len(text))
    same = inside & (text[np.clip(rows, 0, max(0, len(text) - 1))] == template[:, None]) if len(text) else inside
    start = 2 * one + (1 << _MATCHED) + (_FAR - np.minimum(np.maximum(rows, 0), _FAR))
    best, best_end = 0, 0
    before = np.zeros(wide + 1, np.int64)
    for j in range(len(template)):
        if not same[j].any() and not before.any():
            continue
        held = before[:-1]
        cells = np.where(same[j], np.where(held >= one, held + (2 * one + (1 << _MATCHED)), start[j]), held - one)
        cells = np.maximum(cells, before[1:] - one)
        cells = np.maximum.accumulate(cells + offsets * one) - offsets * one
        cells[(cells < one) | ~inside[j]] = 0
        top = int(cells.argmax())
        if cells[top] >> _SCORE > best >> _SCORE:
            best, best_end = int(cells[top]), int(rows[j, top]) + 1
        before[:-1] = cells
    return (best >> _MATCHED) & _FAR, _FAR - (best & _FAR), best_end


def enough(matched: int, n: int) -> bool:
    return matched >= min(LEAST, math.ceil(0.8 * n))


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [_hash(WORD.findall(t.translate(LOWER))) for t in templates.values()]
        self.tables = []
        for size, (k, w) in enumerate(SIZES):
            entries = sorted((int(h[p]), t, p) for t, ws in enumerate(self.words) if (len(ws) >= LONG) == bool(size) for h in [grams(ws, k)] for p in winnow(h, w))
            self.tables.append((k, np.array([e[0] for e in entries], np.uint64), [e[1:] for e in entries]))
        self.known: dict[str, int] = {}

    def candidates(self, ids: np.ndarray) -> dict[int, list[int]]:
        """Diagonals of each template that has hits."""
        found: dict[int, list[int]] = {}
        for k, hashes, places in self.tables:
            own = grams(ids, k)
            if not len(own) or not len(hashes):
                continue
            at = np.searchsorted(hashes, own)
            at[at == len(hashes)] = 0
            for i in np.flatnonzero(hashes[at] == own).tolist():
                h = int(at[i])
                while h < len(hashes) and hashes[h] == own[i]:
                    template, place = places[h]
                    diagonals = found.setdefault(template, [])
                    if not any(abs(i - place - d) <= BAND // 2 for d in diagonals[-4:]):
                        diagonals.append(i - place)
                    h += 1
        return found

    def stretches(self, ids: np.ndarray, template: int, diagonal: int) -> list[tuple[int, int, int]]:
        """(matched, begin, end) of all stretches near a diagonal that match enough."""
        words, found = self.words[template], []
        todo = [(max(0, diagonal - BAND), min(len(ids), diagonal + len(words) + BAND))]
        while todo:
            low, high = todo.pop()
            if high <= low:
                continue
            matched, begin, end = align(ids[low:high], words, diagonal - low, BAND)
            if enough(matched, len(words)):
                found.append((matched, low + begin, low + end))
                todo += [(low, low + begin), (low + end, high)]
        return found

    def scan(self, text: str) -> list[dict]:
        plain = text.translate(LOWER)
        words = WORD.findall(plain)
        if len(self.known) > 300_000:
            self.known.clear()
        known = self.known
        ids = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
        found = {(-m, t, b, e) for t, diagonals in self.candidates(ids).items() for d in diagonals for m, b, e in self.stretches(ids, t, d)}
        kept: list[tuple[int, int, int, int]] = []
        for f in sorted(found):
            if not any(f[2] < g[3] and g[2] < f[3] for g in kept):
                kept.append(f)
        if not kept:
            return []
        spans = [m.span() for m in WORD.finditer(plain)]
        return [{"license": self.names[t], "coverage": -m / len(self.words[t]), "matched_words": -m, "begin": spans[b][0], "end": spans[e - 1][1]} for m, t, b, e in sorted(kept, key=lambda f: f[2])]


FIELDS = "array<struct<license:string,coverage:double,matched_words:int,begin:int,end:int>>"
ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))


def scan(documents: DataFrame, text: str = "text", out: str = "licenses", templates: dict[str, str] | None = None) -> DataFrame:
    """Add ``out``: matches (license, coverage, matched_words, begin, end in code points) in order."""
    used = templates or TEMPLATES

    def make():
        index = Index(used)
        return lambda batch: [pa.array([index.scan(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], ARROW)]

    return map_batches(documents, make, [T.StructField(out, T._parse_datatype_string(FIELDS))])


def matches(documents: DataFrame) -> DataFrame:
    """One row for each match."""
    found = scan(documents.select("doc_id", "text")).where(F.size("licenses") > 0)
    return found.select("doc_id", F.explode("licenses").alias("m")).select("doc_id", "m.*")
