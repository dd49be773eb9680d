"""License scan: MinHash bands over overlapping windows, then exact containment.

Words are runs of letters and digits, lower case, so marks between them don't
hide a notice. A template of m shingles (five words each) is looked for in
windows of 1.5 m shingles every m / 2, so a notice of its length lies whole in
one of them. A window's MinHash signature is cut into bands; a template with an
equal band is retrieved and its containment in the window counted exactly.

Where a window holds ``least`` of a template, their Jaccard similarity is at
least ``least / (2.5 - least)``; :func:`collision` gives the chance that some
band is equal, over 0.9999 with the defaults. A window without any shingle of
any template has no equal minimum with one, so such windows are passed over.

Cases: null and empty texts, and texts of fewer words than a shingle, match
nothing; repeated rows match alike; a text that holds a template several times has
a match for each place (overlapping windows that share words of it are one place,
the earliest of the best of them, so notices without a gap between them are one); of two licenses that share most of their words both may match; an empty
table gives an empty table; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _words
from ._shared import trimmed

# The wording of public licenses, their notices and headers, by the name reported for each.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause": _BSD_TERMS + "\n" + _BSD_END,
    "BSD-3-Clause": _BSD_TERMS + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END,
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _AS_IS,
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
""" + _AS_IS.replace(" OR COPYRIGHT HOLDERS", ""),
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def collision(similarity: float, rows: int = 2, bands: int = 48) -> float:
    """Chance that sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def text_shingles(text: str, size: int = 5) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hashed, _ = _words.words(data, np.array([0, len(data)]), alnum=True)
    return _words.shingles(hashed, size) if len(hashed) >= size else np.empty(0, np.uint64)


class Scanner:
    """Templates by size of window, their shingles and their bands."""

    def __init__(self, templates: dict[str, str], size: int = 5, rows: int = 2, bands: int = 48):
        self.size, self.rows, self.bands = size, rows, bands
        self.salts = _words.mix(np.arange(1, rows * bands + 1, dtype=np.uint64))
        self.sets = {k: np.unique(text_shingles(v, size)) for k, v in templates.items()}
        self.sets = {k: s for k, s in self.sets.items() if len(s)}
        self.known = np.unique(np.concatenate(list(self.sets.values()))) if self.sets else np.empty(0, np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.known & np.uint64(0xFFFF)] = True
        self.tables: dict[int, dict[tuple, list[str]]] = {}
        for name, s in self.sets.items():
            table = self.tables.setdefault(len(s), {})
            for band in self.signature(s):
                table.setdefault(band, []).append(name)

    def signature(self, shingles: np.ndarray) -> list[tuple]:
        low = _words.mix(shingles[None, :] ^ self.salts[:, None]).min(axis=1).reshape(self.bands, self.rows)
        return [(i, *band) for i, band in enumerate(low.tolist())]

    def matches(self, shingles: np.ndarray, least: float) -> list[tuple[str, float, int, int]]:
        """(name, containment, first word, words) of every place, by name and then by place."""
        hits = np.flatnonzero(self.maybe[shingles & np.uint64(0xFFFF)])
        hits = hits[np.isin(shingles[hits], self.known)]
        found: dict[str, list[tuple[float, int, int]]] = {}
        for m, table in self.tables.items() if len(hits) else ():
            width, step = -(-3 * m // 2), max(1, m // 2)
            first = np.maximum(0, -(-(hits - width + 1) // step))
            starts = np.unique(np.concatenate([(first + i)[(first + i) * step <= hits] for i in range(width // step + 1)])) * step
            for at in starts.tolist():
                window = np.unique(shingles[at : at + width])
                for name in sorted({n for band in self.signature(window) for n in table.get(band, ())}):
                    held = len(np.intersect1d(window, self.sets[name], assume_unique=True)) / m
                    if held >= least:
                        places = found.setdefault(name, [])
                        place = (held, at, min(width, len(shingles) - at) + self.size - 1)
                        if places and at < places[-1][1] + width and self._meet(shingles, places[-1][1], at, width, name):
                            places[-1] = max(places[-1], place, key=lambda p: (p[0], -p[1]))
                        else:
                            places.append(place)
        return [(name, *place) for name in sorted(found) for place in found[name]]

    def _meet(self, shingles: np.ndarray, a: int, b: int, width: int, name: str) -> bool:
        """Whether two windows share words of the template, so that they are one place."""
        return bool(np.isin(shingles[b : a + width], self.sets[name]).any())


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", least: float = 0.75, **bands) -> DataFrame:
    """(key, license, containment, first_word, n_words) of every match."""
    templates = TEMPLATES if templates is None else templates
    schema = T.StructType([docs.schema[key], *(T.StructField(c, t) for c, t in (("license", T.StringType()), ("containment", T.DoubleType()), ("first_word", T.LongType()), ("n_words", T.LongType())))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        scanner = Scanner(templates, **bands)
        for batch in batches:
            found = []
            for row, data, offsets in _words.text_parts(batch.column(1)):
                hashed, at = _words.words(data, offsets, alnum=True)
                for i in range(len(offsets) - 1):
                    own = hashed[at[i] : at[i + 1]]
                    if len(own) >= scanner.size:
                        found += [(row + i, *hit) for hit in scanner.matches(_words.shingles(own, scanner.size), least)]
            index = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index).cast(arrow[0].type), *(pa.array([f[c] for f in found], arrow.field(c).type) for c in range(1, 5))], schema=arrow)

    return docs.select(key, text).mapInArrow(trimmed(run), schema)
