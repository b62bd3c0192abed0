"""Licence scans: normalised text compared with licence templates by the Dice coefficient of word bigrams.

A text is searched for the run of words, anywhere in it and across lines and paragraphs, that is most like a
template. Normalising puts ASCII letters in lower case and everything but letters, digits and non-ASCII bytes
aside. Dice is 2 |A n B| / (|A| + |B|) of the sets of bigrams A and B, so a run can only reach ``least`` with
a template of m bigrams if it holds at most m / f different ones and f m of the template's, with
f = least / (2 - least), and no stretch of too many foreign ones. A best run begins and ends with a bigram of
the template. Texts, and stretches of a text, outside these bounds are never compared; the rest are searched
whole, so no run that reaches ``least`` is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship
from lexiwave.llm.bytewords import RunHash, Words, chunks, text_buffers

LEAST = 0.8

# Wordings of public licences and of the notices that refer to them.
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEMPLATES = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        _BSD_TWO,
        f"{_BSD_TWO} {_BSD_END}",
    ),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", f"{_BSD_TWO} {_BSD_THIRD}", f"{_BSD_TWO} {_BSD_THIRD} {_BSD_END}"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "ISC": (_ISC, f"{_ISC} {_ISC_END}"),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "MIT": ("Released under the MIT License.", _MIT, f"{_MIT} {_MIT_END}"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}

_NORMAL = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _NORMAL[_b] = _b
_NORMAL[65:91] = np.arange(97, 123)


def _bigrams(words: Words) -> np.ndarray:
    """Hashes of each word with the next; the last has none (0)."""
    keys = words.keys()
    out = np.zeros(len(keys), np.uint64)
    if len(keys) > 1:
        at = np.arange(len(keys) - 1)
        out[:-1] = RunHash(keys)(at, at + 2)
    return out


class Matcher:
    """Templates as sets of bigrams."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.least, self.share = least, least / (2 - least)
        self.templates = []
        for name in sorted(templates):
            for wording in templates[name]:
                data, offsets = text_buffers(pa.array([wording.replace("\n", " ")]))
                grams = set(_bigrams(Words(_NORMAL[data], offsets))[:-1].tolist())
                if grams:
                    self.templates.append((name, grams))
        self._size = {}
        for name, grams in self.templates:
            self._size[name] = max(len(grams), self._size.get(name, 0))
        self._all = np.unique(np.array([g for _, grams in self.templates for g in grams], np.uint64))
        self._holds = [np.isin(self._all, np.array(list(grams), np.uint64)) for _, grams in self.templates]

    def best(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[float, str | None]]:
        """The first of ``all`` by text, and (0, None) where there is none."""
        return [found[0] if found else (0.0, None) for found in self.all(data, offsets)]

    def all(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[float, str]]]:
        """(largest Dice of a run of words, licence) of all licences found, by text.

        The largest Dice comes first; of equals the licence whose longest template is longer, then the first name.
        """
        found: list[dict[str, float]] = [{} for _ in range(len(offsets) - 1)]
        self._find(data, offsets, found)
        return [sorted(((d, n) for n, d in f.items()), key=lambda x: (-x[0], -self._size[x[1]], x[1])) for f in found]

    def _find(self, data: np.ndarray, offsets: np.ndarray, out: list[dict[str, float]]) -> None:
        words = Words(_NORMAL[data], offsets)
        if len(words.start) < 2 or not len(self._all):
            return
        grams = _bigrams(words)
        place = np.minimum(np.searchsorted(self._all, grams), len(self._all) - 1)
        joined = np.append(words.doc[1:] == words.doc[:-1], False)
        known = np.flatnonzero((self._all[place] == grams) & joined)
        for (name, other), holds in zip(self.templates, self._holds):
            hits = known[holds[place[known]]]
            need = max(1, int(np.ceil(self.share * len(other) - 1e-9)))
            counts = np.bincount(words.doc[hits], minlength=len(out))
            ends = np.cumsum(counts)
            for text in np.flatnonzero(counts >= need).tolist():
                mine = hits[ends[text] - counts[text] : ends[text]]
                dice = self._run(grams, mine, other, need)
                if dice >= self.least:
                    out[text][name] = max(dice, out[text].get(name, 0.0))

    def _run(self, grams: np.ndarray, hits: np.ndarray, other: set[int], need: int) -> float:
        """Largest Dice of a run with a template that has its bigrams at ``hits``; 0 if none reaches ``least``."""
        if len(np.unique(grams[hits])) < need:
            return 0.0
        size, best = len(other), 0.0
        most = int(size / self.share + 1e-9)
        foreign = int(size * ((1 - self.least / 2) / self.share - self.least / 2) + 1e-9)
        cuts = [g + 1 for g in np.flatnonzero(np.diff(hits) > foreign + 1).tolist() if len(np.unique(grams[hits[g] + 1 : hits[g + 1]])) > foreign]
        for a, b in zip([0, *cuts], [*cuts, len(hits)]):
            if b - a >= need and len(np.unique(grams[hits[a:b]])) >= need:
                best = max(best, self._slide(grams[hits[a] : hits[b - 1] + 1].tolist(), other, most, need))
        return best

    def _slide(self, grams: list[int], other: set[int], most: int, need: int) -> float:
        """Largest Dice of the runs in ``grams``; 0 if none reaches ``least``.

        From the last start to the first, ``recent`` holds the ``most`` different bigrams that a run from
        there meets first, the first met last: its ends are all the sets of bigrams that matter.
        """
        recent: list[int] = []
        held: set[int] = set()
        shared, best = 0, 0.0
        for g in reversed(grams):
            if g in held:
                recent.remove(g)
            else:
                if len(recent) == most:
                    gone = recent.pop(0)
                    held.discard(gone)
                    shared -= gone in other
                held.add(g)
                shared += g in other
            recent.append(g)
            if g in other and shared >= need and 2 * shared / (shared + len(other)) > best:
                common = np.cumsum([x in other for x in reversed(recent)])
                dice = float((2 * common / (np.arange(1, len(recent) + 1) + len(other))).max())
                if dice >= self.least:
                    best = max(best, dice)
                if best == 1:
                    break
        return best


def read_templates(folder: str) -> dict[str, tuple[str, ...]]:
    """Licence texts of a folder on the driver, a file each, by file name: whole texts that are not built in."""
    return {f.name: (f.read_text(errors="replace"),) for f in sorted(Path(folder).iterdir()) if f.is_file()}


def built_in() -> dict[str, tuple[str, ...]]:
    """``TEMPLATES`` and the whole texts that lie beside this module, a file a licence; read on the driver, for tasks get them with their function."""
    whole = read_templates(str(Path(__file__).parent / "licence_texts"))
    return {name: (*TEMPLATES.get(name, ()), *whole.get(name, ())) for name in sorted(TEMPLATES.keys() | whole.keys())}


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, least: float = LEAST) -> DataFrame:
    """One row per input row: id, licence (the best, null if none), dice (0 if none) and licences, all found.

    Null and empty texts have none. Rows are independent, so repeated rows give equal results; of equal
    coefficients the licence with the longer template is the best, then the first name. A very long text is searched whole, in
    time in proportion to its words. An empty table gives an empty result and other columns are ignored.
    """
    ship(docs.sparkSession)
    chosen = built_in() if templates is None else templates
    kind = "id long, licence string, dice double, licences array<struct<licence: string, dice: double>>"
    each = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64())]))
    schema = pa.schema([("id", pa.int64()), ("licence", pa.string()), ("dice", pa.float64()), ("licences", each)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(chosen, least)
        for batch in batches:
            for part in chunks(batch, "text"):
                found = matcher.all(*text_buffers(part.column(1)))
                first = [f[0] if f else (0.0, None) for f in found]
                listed = [[{"licence": n, "dice": d} for d, n in f] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n in first], pa.string()), pa.array([d for d, _ in first], pa.float64()), pa.array(listed, each)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, kind)


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, licence, dice and licences (``name:dice`` by rank, joined by commas) of every document."""
    one = lambda x: F.concat_ws(":", x["licence"], F.format_number(x["dice"], 6))
    out = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "licence", "dice", F.array_join(F.transform("licences", one), ",").alias("licences"))
