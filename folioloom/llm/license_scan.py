"""License scanning by conditional compression.

1. Candidate blocks: as many words as the longest template has on both sides of each
   cue word, joined where they meet; so wrapping, blank lines and a lack of cues in
   the middle of a wording don't part it.
2. In a block, each template is aligned with the words (lower case, punctuation
   apart) at least cost: a word of the template that is lacking costs 1, a word
   between costs ``BETWEEN``. Templates of which the block has too few words anywhere
   are passed over, without loss. An alignment counts where the words that are lacking
   are at most ``MISSING`` of the template.
3. The span that agrees is compressed alone and with the template as a raw zstandard
   dictionary. The size reduction, over the lesser of the span's own size and the
   template's, must be ``REDUCTION`` or more.
4. The alignment with the most words less cost is a license found, with its
   differences kept: words the span lacks and words it has instead, between the first
   and the last word that agree. Its words are taken; the search goes on in the others
   until nothing is left. Long blocks are swept in windows that overlap by half.

Texts stay where they are: one scan, no shuffle.

Defined results: null and empty texts give no rows; repeated rows give repeated
results; ties go to the greater reduction, then to the template that sorts first; an empty table
gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import prepare, released, texts

REDUCTION = 0.3
MISSING = 0.25
BETWEEN = 0.25
#: Half a window, in lengths of the longest template.
SWEEP = 3
LEVEL = 5

CUES = r"licen[cs]|copyright|\(c\)|all\W+rights\W+reserved|permission|redistribut|warrant|public\W+domain|spdx|creative\W+commons|\bcc\W+by|\bcc0"

#: Wordings of public licenses and notices (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GFDL-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Artistic-2.0": "This package is licensed under the Artistic License 2.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Distributed under the BSD License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}

_CUE = re.compile(CUES, re.I)
_BREAK = re.compile(r"\W*\n\W*")
_STEP = 1 << 16
_WHOLE = int(_STEP / BETWEEN)
#: Words end at hyphens, where lines are broken too.
_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str, reach: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidate blocks of a text: ``reach`` words around each cue."""
    cues = [(m.start(), m.end()) for m in _CUE.finditer(text)]
    if not cues:
        return
    spans = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    held: list[int] | None = None
    for a, b in cues:
        lo, hi = max(0, bisect.bisect_right(ends, a) - reach), min(len(spans), bisect.bisect_left(starts, b) + reach)
        if held and lo <= held[1]:
            held[1] = hi
        else:
            if held and held[0] < held[1]:
                yield starts[held[0]], ends[held[1] - 1]
            held = [lo, hi]
    if held and held[0] < held[1]:
        yield starts[held[0]], ends[held[1] - 1]


class Templates:
    """Compressors with each template as a raw dictionary."""

    def __init__(self, templates: dict[str, str] | None = None, level: int = LEVEL):
        import numpy as np
        import zstandard as z

        self.texts = dict(sorted((templates or TEMPLATES).items()))
        self.words = {k: words(t) for k, t in self.texts.items()}
        self.numbers = {w: i for i, w in enumerate(sorted({w for x in self.words.values() for w in x}))}
        self.ids = {k: np.array([self.numbers[w] for w in x], np.int64) for k, x in self.words.items() if x}
        self.counts = {k: np.bincount(x, minlength=len(self.numbers)) for k, x in self.ids.items()}
        self.longest = max(map(len, self.words.values()), default=0)
        self.alone = z.ZstdCompressor(level=level, write_content_size=False)
        self.own = {k: len(self.alone.compress(t.encode())) for k, t in self.texts.items()}
        self.given = {}
        for name, text in self.texts.items():
            d = z.ZstdCompressionDict(text.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.given[name] = z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)

    def reduction(self, span: str, name: str) -> float:
        """Share of the size that the template saves; line breaks count as a blank."""
        data = _BREAK.sub(" ", span).encode()
        alone = len(self.alone.compress(data))
        return (alone - len(self.given[name].compress(data))) / min(alone, self.own[name])

    def best(self, have, name: str, missing: float):
        """(score, places of words that agree, template's words that lack), or None; scores are in 65536ths of ``BETWEEN``."""
        import numpy as np

        want = self.ids[name]
        m, n = len(want), len(have)
        cost = np.zeros((m + 1, n + 1), np.int64)  # the low 16 bits count the words that agree
        ramp = np.arange(n + 1) * _STEP
        for i in range(m):
            row = cost[i] - _WHOLE
            np.maximum(row[1:], cost[i, :-1] + (_WHOLE + 1), out=row[1:], where=have == want[i])
            row += ramp
            np.maximum.accumulate(row, out=row)
            cost[i + 1] = row - ramp
        fit = m - (cost[m] & 0xFFFF) <= missing * m
        if not fit.any():
            return None
        j = int(np.where(fit, cost[m], np.iinfo(np.int64).min).argmax())
        i, score, places, lacks = m, int(cost[m, j]), [], []
        while i:
            if j and have[j - 1] == want[i - 1] and cost[i, j] == cost[i - 1, j - 1] + _WHOLE + 1:
                i, j = i - 1, j - 1
                places.append(j)
            elif cost[i, j] == cost[i - 1, j] - _WHOLE:
                i -= 1
                lacks.append(i)
            else:
                j -= 1
        return (score, places[::-1], lacks[::-1]) if places else None

    def confirmed(self, block: str, reduction: float, missing: float) -> list[dict]:
        """Licenses of a block, in order, with their spans in it."""
        import numpy as np

        found = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(block)]
        have = np.array([self.numbers.get(w, -1) for *_, w in found], np.int64)
        half = SWEEP * self.longest
        out: list[dict] = []

        def look(near, at: int, name: str):
            """The template's best alignment in a window whose span saves enough."""
            near = near.copy()
            while (np.minimum(np.bincount(near[near >= 0], minlength=len(self.numbers)), self.counts[name])).sum() >= len(self.ids[name]) * (1 - missing):
                if not (hit := self.best(near, name, missing)):
                    return None
                score, places, lacks = hit
                gain = self.reduction(block[found[at + places[0]][0] : found[at + places[-1]][1]], name)
                if gain >= reduction:
                    return score, gain, places, lacks
                near[places] = -1
            return None

        for at in range(0, max(1, len(found) - half), max(1, half)):
            near = have[at : at + 2 * half].copy()
            final = at + 2 * half >= len(found)
            open_ = {name: hit for name in self.ids if (hit := look(near, at, name))}
            while open_:
                name = min(open_, key=lambda k: (-open_[k][0], -open_[k][1], k))
                score, gain, places, lacks = open_[name]
                near[places] = -1
                if final or places[0] < half:  # others start in the next window, which has them whole
                    have[at + np.array(places)] = -1
                    lo, hi, agreed = at + places[0], at + places[-1], set(places)
                    other = [found[k][2] for k in range(lo, hi) if k - at not in agreed]
                    want = self.words[name]
                    out.append({"start": found[lo][0], "end": found[hi][1], "license": name, "reduction": round(gain, 6), "missing": round(len(lacks) / len(want), 6), "exact": not lacks and not other, "lacks": " ".join(want[k] for k in lacks), "instead": " ".join(other)})
                for k in [k for k, x in open_.items() if not set(places).isdisjoint(x[2])]:
                    if hit := look(near, at, k):
                        open_[k] = hit
                    else:
                        del open_[k]
        return sorted(out, key=lambda x: (x["start"], x["end"], x["license"]))


_READY: list[Templates] = []


def _scan(templates: dict[str, str] | None, reduction: float, missing: float):
    def run(batches):
        import pyarrow as pa

        if templates is None:
            if not _READY:
                _READY.append(Templates())
            ready = _READY[0]
        else:
            ready = Templates(templates)
        names = ["key", "start", "end", "license", "reduction", "missing", "exact", "lacks", "instead"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string(), pa.string()]
        seen: dict[str, list[dict]] = {}
        for batch in released(batches):
            rows: list[tuple] = []
            for i, text in enumerate(texts(batch.column(1))):
                for start, end in blocks(text or "", ready.longest):
                    block = text[start:end]
                    if block not in seen:
                        if len(seen) > 20_000:
                            seen.clear()
                        seen[block] = ready.confirmed(block, reduction, missing)
                    rows += [(i, start + x["start"], start + x["end"], *(x[n] for n in names[3:])) for x in seen[block]]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], names=names)

    return run


def scan(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, reduction: float = REDUCTION, missing: float = MISSING) -> DataFrame:
    """One row per license found: doc_id, start, end, license, reduction, missing, exact, lacks, instead."""
    prepare(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"key {kind}, start bigint, end bigint, license string, reduction double, missing double, exact boolean, lacks string, instead string"
    chosen = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(f"(?i){CUES}"))
    return chosen.mapInArrow(_scan(templates, reduction, missing), schema).withColumnRenamed("key", "doc_id")
