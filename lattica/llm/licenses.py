"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports what matches."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a fingerprinted run, and runs in a winnowing window: any SHINGLE + WINDOW - 1 consecutive words shared with a template are found.
SHINGLE, WINDOW = 3, 2
#: Words by which an alignment may drift from its diagonal.
BAND = 8
#: Share of a template's words that a match must have.
COVERAGE = 0.8

#: Whole texts, their parts, and notices as license stewards word them.
TEMPLATES = {
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-reference": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-2-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-4.0-reference": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-reference": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-reference": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-reference": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-reference": "Released under the MIT License.",
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense-dedication": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}
#: Names of licenses in short references, which must be there word by word, as must SPDX identifiers.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License v3", "GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License"],
    "CC-BY-4.0": ["licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["licensed under CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["licensed under CC BY-SA 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "GPL-2.0": ["GNU General Public License v2", "GNU General Public License, version 2", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License v3", "GNU General Public License, version 3", "GNU GPL v3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License v3", "GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "Unlicense": ["The Unlicense"],
}


def references() -> dict[str, str]:
    """License of each wording of a short reference."""
    found = {name: k for k, several in NAMES.items() for name in several}
    return found | {f"SPDX-License-Identifier: {k}{end}": k for k in NAMES for end in (("", "-only", "-or-later") if "GPL" in k else ("",))}


_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))
_NONE = np.uint64(2**64 - 1)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def grams(ids: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each run of `shingle` word numbers; a run with an unknown word (0) has the largest, which is never selected."""
    n = len(ids) - shingle + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    ids = ids.astype(np.uint64)
    out, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for j in range(shingle):
        part = ids[j : j + n]
        known &= part > 0
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.where(known, np.minimum(out, _NONE - np.uint64(1)), _NONE)


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of each window (the last of equal ones); of all of them, if there is less than a window."""
    if len(hashes) == 0:
        return np.zeros(0, dtype=np.int64)
    if len(hashes) <= window:
        places = np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    else:
        view = np.lib.stride_tricks.sliding_window_view(hashes, window)
        places = np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))
    return places[hashes[places] != _NONE]


def align(template: list[int], text: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment of the whole template with words of text near text place =
    template place + diagonal. Matches count 1; words left out on either side count 0.25 against it."""
    lo = diagonal - band
    width = 2 * band + 1
    # best[k]: (score, matches, first, end) with the template read up to row i and the text up to i + lo + k
    best = [(0.0, 0, -1, -1)] * width
    top = (0.0, 0, -1, -1)
    for i, t in enumerate(template):
        new = []
        for k in range(width):
            j = i + lo + k
            score, n, first, end = best[k]
            if 0 <= j < len(text) and text[j] == t:
                here = (score + 1, n + 1, j if first < 0 else first, j + 1)
            else:
                here = (score - 0.25, n, first, end)
            if k + 1 < width and best[k + 1][0] - 0.25 > here[0]:  # a template word that the text lacks
                here = (best[k + 1][0] - 0.25, *best[k + 1][1:])
            if k and new[k - 1][0] - 0.25 > here[0]:  # a text word that the template lacks
                here = (new[k - 1][0] - 0.25, *new[k - 1][1:])
            if here[0] < 0:
                here = (0.0, 0, -1, -1)
            if here[0] > top[0]:
                top = here
            new.append(here)
        best = new
    return top[1], top[2], top[3]


class Scanner:
    def __init__(self, templates: dict[str, str], shingle: int = SHINGLE, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE, short: dict[str, str] | None = None):
        self.short = {b" ".join(words(w)): k for w, k in (short or {}).items()}
        longest = sorted(self.short, key=lambda w: (-len(w), w))
        self.find_short = re.compile(b"(?<![^ ])(?:" + b"|".join(map(re.escape, longest)) + b")(?![^ ])") if longest else None
        self.number: dict[bytes, int] = {}
        self.names = sorted(templates)
        self.ids = [[self.number.setdefault(w, len(self.number) + 1) for w in words(templates[n])] for n in self.names]
        self.band, self.coverage, self.shingle, self.window = band, coverage, shingle, window
        index = defaultdict(list)
        for t, ids in enumerate(self.ids):
            hashes = grams(np.array(ids), shingle)
            for p in winnowed(hashes, window):
                index[int(hashes[p])].append((t, int(p)))
        self.index = dict(index)
        self.keys = np.array(sorted(self.index), dtype=np.uint64)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, word after the last, matched words) of each match, in order of places."""
        out = self._aligned(have := words(text))
        if self.find_short:
            taken, line = [(m[2], m[3]) for m in out], b" ".join(have)
            for hit in self.find_short.finditer(line):
                first = line.count(b" ", 0, hit.start())
                end = first + hit[0].count(b" ") + 1
                if not any(first < e and f < end for f, e in taken):
                    out.append((f"{self.short[hit[0]]}-reference", 1.0, first, end, end - first))
        return sorted(out, key=lambda m: (m[2], m[0]))

    def _aligned(self, have: list[bytes]) -> list[tuple[str, float, int, int, int]]:
        """Matches of the templates."""
        ids = np.fromiter(map(self.number.get, have, [0] * len(have)), dtype=np.int64, count=len(have))
        if np.count_nonzero(ids) < self.shingle or not len(self.keys):
            return []
        hashes = grams(ids, self.shingle)
        some = winnowed(hashes, self.window)
        if not len(some):
            return []
        at = np.searchsorted(self.keys, hashes[some]).clip(max=len(self.keys) - 1)
        hits = some[self.keys[at] == hashes[some]]
        places = defaultdict(set)
        for p in hits.tolist():
            for t, q in self.index[int(hashes[p])]:
                places[t].add(p - q)
        listed, out = ids.tolist(), []
        for t, diagonals in places.items():
            done = None
            for d in sorted(diagonals):
                if done is not None and d - done <= self.band:
                    continue
                done = d
                low = max(0, d - self.band)
                part = listed[low : d + len(self.ids[t]) + self.band]
                n, first, end = align(self.ids[t], part, d - low, self.band)
                share = n / len(self.ids[t])
                if share >= self.coverage:
                    out.append((self.names[t], share, low + first, low + end, n))
        best: dict = {}
        for m in sorted(out, key=lambda m: (-m[4], -m[1], m[2], m[0])):
            # of templates at one place the one with the most words stands
            if not any(m[2] < e and f < m[3] for f, e in best):
                best[m[2], m[3]] = m
        return sorted(best.values(), key=lambda m: (m[2], m[0]))


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Per match in docs (doc_id, text): doc_id, license, coverage (share of the template's words, rounded to 4 places),
    word_start, word_end, n_matched.

    Words are runs of letters and digits with A-Z lower-cased. Templates are indexed by winnowed runs of words; where a document shares one, the
    template is aligned within a band around that diagonal. Matches that cover less are left out, and of matches that overlap the one with
    the most words stands. Short references are names and SPDX identifiers of licenses outside of other matches, found word by word.
    Of Apache, MPL, CC and the GNU licenses notices and references are known, not the whole texts. Documents without a match have no row; null and blank texts have none; repeated rows are
    scanned each; templates with fewer words than a run are never found; an empty table gives none.
    """
    given = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        scanner = Scanner(given, coverage=coverage, short=references() if templates is None else None)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [(d, *m) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for m in scanner.scan(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([round(r[2], 4) for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64())],
                    ["doc_id", "license", "coverage", "word_start", "word_end", "n_matched"],
                )

    fields = "doc_id long, license string, coverage double, word_start long, word_end long, n_matched long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)
