"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tables, text

#: Words of a fingerprint, and fingerprints of a winnowing window for notices and for whole texts.
GRAM, WINNOW_NOTICE, WINNOW_TEXT = 3, 2, 6
#: The least number of words by which an alignment may leave its diagonal; long templates have as many as a match may lack.
BAND = 12
#: Share of a template's words that a match must hold; it may hold as many other words as it may lack.
COVERAGE = 0.75
#: Words from which a template needs two fingerprints near each other before it is aligned.
LONG = 40

#: Notices and headers by which licenses are named, (license, words). The numbers and variant names in
#: them tell licenses apart, so a match must have exactly those.
NOTICES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Titles, and identifiers after "SPDX-License-Identifier:". A match must have exactly these words.
TITLES = (("MIT", "The MIT License MIT"), ("MIT", "MIT License Copyright (c)"), ("ISC", "ISC License Copyright (c)"))
IDENTIFIERS = (
    "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
#: The names that tell variants of a license apart, beside numbers.
VARIANTS = ("affero", "lesser", "library", "nc", "nd", "noncommercial", "noderivatives", "noderivs", "sa", "sharealike")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: License texts, and for the longest licenses the sections that say what is granted, (license, words).
TEXTS = (
    ("Apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("Apache-2.0", "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted."),
    ("Apache-2.0", "Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work; and"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
TEMPLATES = (
    *((name, body, "notice") for name, body in NOTICES), *((name, body, "text") for name, body in TEXTS), *((name, body, "exact") for name, body in TITLES),
    *((name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}", "exact") for name in IDENTIFIERS),
)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window, the last of equal ones."""
    if len(hashes) <= window:
        return np.flatnonzero(hashes == hashes.min())[-1:] if len(hashes) else np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(runs)) + window - 1 - runs[:, ::-1].argmin(1))


def _hashed(body: str) -> tuple[np.ndarray, list[bytes]]:
    """The hashes of a text's words, and the words."""
    (_, _, data, offsets), *_ = [*text.slices(pa.array([body], pa.large_string()), 1 << 40)]
    starts, ends, _ = text.words(data, offsets, text.ALPHANUMERIC)
    return text.span_hashes(data, starts, ends), [data[s:e].tobytes() for s, e in zip(starts, ends)]


class Templates:
    """Word hashes of all templates and an inverted index of their winnowed fingerprints.

    templates: (license, words, kind). The numbers and variant names in a match of a "notice" must be those of the template,
    an "exact" one must be matched word for word, and the coverage of a "text" is taken over all that is known of its
    license: its longest text and those that aren't part of it."""

    def __init__(self, templates: list[tuple[str, str, str]]) -> None:
        self.names: list[str] = []
        self.words: list[np.ndarray] = []
        self.kinds: list[str] = []
        self.strict: list[np.ndarray] = []
        index: dict[int, list[tuple[int, int]]] = {}
        for name, body, kind in templates:
            h, words = _hashed(body)
            if len(h) < GRAM:
                raise ValueError(f"a template needs {GRAM} words: {body!r}")
            grams = text.windows(h, GRAM)
            for at in winnow(grams, WINNOW_TEXT if kind == "text" else WINNOW_NOTICE).tolist():
                index.setdefault(int(grams[at]), []).append((len(self.names), at))
            self.names.append(name)
            self.words.append(h)
            self.kinds.append(kind)
            self.strict.append(np.array([x[:1].isdigit() or x.lower().decode() in VARIANTS for x in words]))
        self.index = index
        self.telling = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h[w] for h, w, k in zip(self.words, self.strict, self.kinds) if k == "notice"), _hashed(" ".join([*VARIANTS, *map(str, range(10))]))[0]]))
        self.likely = np.zeros(1 << 16, bool)
        self.likely[[x & 0xFFFF for x in index]] = True
        self.whole = [len(h) if k != "text" else self._known(name) for name, h, k in zip(self.names, self.words, self.kinds)]

    def _known(self, name: str) -> int:
        """Words of a license's texts, without those that begin another one."""
        own = sorted({tuple(h.tolist()) for n, h, k in zip(self.names, self.words, self.kinds) if n == name and k == "text"}, key=len)
        return sum(len(h) for k, h in enumerate(own) if not any(other[: len(h)] == h for other in own[k + 1 :]))

    def says(self, k: int, span: np.ndarray) -> bool:
        """Whether the telling words of a span are those of the template, in order."""
        if self.kinds[k] == "exact":
            return np.array_equal(span, self.words[k])
        if self.kinds[k] == "text":
            return True
        return np.array_equal(span[np.isin(span, self.telling)], self.words[k][self.strict[k]])


def align(template: np.ndarray, words: np.ndarray, at: int, band: int = BAND) -> tuple[int, int, int]:
    """Best banded alignment of a whole template with words near the diagonal that starts at word `at`.

    Returns how many words match in order, and the first and end word of the match; of equal ones the shortest, then
    the last. Row by row; a cell holds in one number the matches so far, what their span lacks to the limit, and the
    first of them, so that the largest is the best.
    """
    n, width = len(template), 2 * band + 1
    if not len(words):
        return 0, 0, 0
    # Column c of row i is word at - band + i + c; words outside match nothing.
    low, last, most = at - band, len(words), (1 << 20) - 1
    best = np.zeros(width, np.int64)
    for i in range(n):
        place = i + np.arange(width)
        word = low + place
        same = (word >= 0) & (word < last)
        same &= words[np.clip(word, 0, last - 1)] == template[i]
        # The cell before, for a match: the word before in the row before, which stands in the same column there.
        count = best >> 40
        start = np.where(count > 0, best & most, place)
        grown = ((count + 1) << 40) | ((most - (place - start)) << 20) | start
        skipped = np.append(best[1:], best[-1])
        best = np.maximum.accumulate(np.where(same, np.maximum(grown, skipped), skipped))
    top = int(best.max())
    if not top >> 40:
        return 0, 0, 0
    start, span = top & most, most - (top >> 20 & most)
    return top >> 40, low + start, low + start + span + 1


def find_licenses(templates: Templates, hashes: np.ndarray, grams: np.ndarray, coverage: float = COVERAGE) -> list[tuple[str, int, int, float]]:
    """(license, first word, end word, coverage) of one text; of overlapping matches the one with most words."""
    anchors: dict[int, list[tuple[int, int]]] = {}
    for at in np.flatnonzero(templates.likely[(grams & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
        for k, place in templates.index.get(int(grams[at]), ()):
            anchors.setdefault(k, []).append((at - place, at))
    found = []
    for k, own in anchors.items():
        words = templates.words[k]
        may_lack = int((1 - coverage) * len(words) + 1e-9)
        band = max(BAND, may_lack)
        left, own = hashes, sorted(own)
        while own:
            # A match leaves its first diagonal by a band at most, so anchors chain over a band, and an alignment of twice
            # its width about their middle holds any match that one of them is part of.
            chain = [x for x in own if x[0] <= own[0][0] + band]
            if len(words) >= LONG and len(chain) < 2:
                own = own[1:]
                continue
            count, start, end = align(words, left, (chain[0][0] + chain[-1][0]) // 2, 2 * band)
            if count < coverage * len(words) or end - start - count > may_lack or not templates.says(k, left[start:end]):
                own = own[len(chain) :]
                continue
            found.append((count, count / len(words), templates.names[k], start, end, count / templates.whole[k]))
            left = left.copy() if left is hashes else left
            left[start:end] = 0
            own = [x for x in own if not start <= x[1] < end]
    out: list[tuple[str, int, int, float]] = []
    for _, _, name, start, end, share in sorted(found, key=lambda x: (-x[0], -x[1], x[3], x[2])):
        if not any(s < end and start < e for _, s, e, _ in out):
            out.append((name, start, end, min(share, 1.0)))
    return sorted(out, key=lambda x: x[1])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | tuple = TEMPLATES, text_col: str = "text", id_col: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """License notices of each whole text: id_col, n_matches, licenses (distinct, sorted), coverage (the best, 4
    places; 0 without a match) and matches (license, start, end in code points, coverage).

    A match may lack a quarter of its template's words and hold as many others, in the middle too. Of texts of variants
    that differ by a clause, that counts of which more words are there; of equal ones, that with less left over. Coverage
    is of all that the templates know of the license, so a first sentence alone has little. Texts of any length are
    scanned whole.

    A row for each input row; null texts have no match; repeated rows are scanned each; other columns aren't read. The
    templates, a bounded list, go to the tasks with the code. A narrow stage of one pass.
    """
    pairs = list(templates)

    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(pairs)
        for batch in batches:
            for a, b, data, offsets in text.slices(batch.column(1)):
                starts, ends, first = text.words(data, offsets, text.ALPHANUMERIC)
                hashes = text.span_hashes(data, starts, ends)
                grams = text.windows(hashes, GRAM)
                likely = np.flatnonzero(known.likely[(grams & np.uint64(0xFFFF)).astype(np.int64)])
                rows = set((np.searchsorted(first, likely, "right") - 1).tolist())
                matches: list[list[dict]] = [[] for _ in range(b - a)]
                for r in rows:
                    x, y = int(first[r]), int(first[r + 1])
                    own = find_licenses(known, hashes[x:y], grams[x : max(x, y - GRAM + 1)], coverage)
                    if own:
                        at = text.char_starts(data[offsets[r] : offsets[r + 1]])
                        matches[r] = [{"license": n, "start": int(at[starts[x + s] - offsets[r]]), "end": int(at[ends[x + e - 1] - offsets[r]]), "coverage": round(c, 4)} for n, s, e, c in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(m) for m in matches], pa.int64()), pa.array([sorted({x["license"] for x in m}) for m in matches], pa.list_(pa.string())), pa.array([max((x["coverage"] for x in m), default=0.0) for m in matches]), pa.array(matches, pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])))], [id_col, "n_matches", "licenses", "coverage", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_matches long, licenses array<string>, coverage double, matches array<struct<license:string,start:long,end:long,coverage:double>>")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_matches", F.array_join("licenses", ",").alias("licenses"), "coverage", spans.alias("spans"))
