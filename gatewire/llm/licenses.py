"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

A text is compared in three kinds of units: every line (one-line notices), its header
(the leading comment, or else the first paragraph, with its lines joined) and the whole text
(licence files).  Units and templates are sparse rows of tf * idf over lower-case
words; the inverse document frequencies are those of the words among all documents (a
template word's count is taken in one pass, words in no template count as found in
one document).  A unit matches the template with the highest cosine if that is at
least ``THRESHOLD``.  Two bounds leave units out early, and lose no match: a unit
must hold an anchor word of a template (its rarest words, as many as are needed for
the others alone to stay below the threshold), and the template words in it must weigh enough
against the others.  Templates are whole texts of short licences, and the notices, headers
and titles of long ones; callers may give others.

A file's own licence is that of its best unit, of equally good ones a line's before the
header's before the whole's.  A file is a licence file if its name says so or if
matching units of one kind hold at least ``FILE_SHARE`` of its words.  A file
without a licence of its own gets that of the nearest directory above it that has
a licence file (of several the best match, then the first by name), by joining
the directories' ancestors with the licence files' directories.

Defined cases: NULL counts as empty and has no own licence; NULL paths inherit
nothing; repeated rows give repeated results; lines, headers and texts count whole, however long;
an empty table gives no rows; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .common import ready, slices, stored

THRESHOLD = 0.7
FILE_SHARE = 0.5
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"

#: A shebang and blank lines, then a block comment, lines of comment, or the lines up to a blank one.
HEADER = re.compile(
    rb"(?:#![^\n]*\n)?\s*(?:/\*.*?\*/|<!--.*?-->|(?:[ \t]*(?:\#|//|--|;|%|\*)[^\n]*(?:\n|\Z))+|(?:[ \t]*\S[^\n]*(?:\n|\Z))+)", re.DOTALL
)

#: Parts that the texts of several licences share.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu_header(name: str, version: str, later: bool = True) -> str:
    """The header that the GNU licences ask for."""
    either = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version}."
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the "
        f"Free Software Foundation, {either} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Public notices, headers, titles and short texts of common licences.
TEMPLATES = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        _gnu_header("GNU Affero General Public License", "3"),
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "SPDX-License-Identifier: Apache-2.0",
        (
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
            "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
            "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
        ),
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause",
        "BSD 2-Clause License " + _BSD_GRANT + _BSD_AS_IS,
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License " + _BSD_GRANT + _BSD_NAMES + _BSD_AS_IS,
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0",
        _gnu_header("GNU General Public License", "2"),
        _gnu_header("GNU General Public License", "2", later=False),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0",
        _gnu_header("GNU General Public License", "3"),
    ),
    "ISC": (
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
        (
            "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
            "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
            "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
        ),
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        _gnu_header("GNU Lesser General Public License", "3"),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-3.0",
    ),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
        (
            "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
            "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
            "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
            "shall be included in all copies or substantial portions of the Software. " + _AS_IS
        ),
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
            "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
        ),
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": ("All rights reserved. Proprietary and confidential.",),
}


def _hashes(texts: list[str]):
    return W.word_hashes(pa.array([t.lower() for t in texts], pa.large_string()))


def vocabulary(templates=TEMPLATES) -> np.ndarray:
    return np.unique(_hashes([t for texts in templates.values() for t in texts])[0])


def _frequencies(words: np.ndarray):
    def run(batches):
        total = np.zeros(len(words), np.int64)
        rows = 0
        for batch in batches:
            for part in slices(batch, "__text"):
                rows += part.num_rows
                found, owner = W.word_hashes(part.column("__text"))
                at = np.minimum(np.searchsorted(words, found), len(words) - 1)
                known = words[at] == found
                keys = np.unique(owner[known] * len(words) + at[known])
                total += np.bincount(keys % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(words)), pa.int32()), pa.array(np.append(rows, total))], names=["word", "n"]
        )

    return run


class Matcher:
    """Templates as lists of (template, weight) by word, with the words' weights and the anchors."""

    def __init__(self, documents: int, frequencies: np.ndarray, templates=TEMPLATES) -> None:
        self.words = vocabulary(templates)
        self.idf = np.log((documents + 1) / (frequencies + 1)) + 1
        self.other = float(np.log((documents + 1) / 2) + 1)
        texts = [(name, text) for name, many in templates.items() for text in many]
        self.names = [name for name, _ in texts]
        found, owner = _hashes([text for _, text in texts])
        values, of, times = W.distinct(found, owner)
        at = np.searchsorted(self.words, values)
        weight = times * self.idf[at]
        weight /= np.sqrt(np.bincount(of, weight**2, len(texts)))[of]
        self.anchors = np.zeros(len(self.words), bool)
        for t in range(len(texts)):
            mine = np.flatnonzero(of == t)
            mine = mine[np.lexsort((-weight[mine], -self.idf[at[mine]]))]
            left = 1 - np.cumsum(weight[mine] ** 2)
            self.anchors[at[mine[: np.searchsorted(-left, -(THRESHOLD**2) * 0.999, "left") + 1]]] = True
        # the templates of each word, one word after the other
        order = np.lexsort((of, at))
        self.template, self.weight = of[order], weight[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.words) + 1))

    def units(self, found: np.ndarray, unit: np.ndarray, units: int):
        """(unit, template, cosine) of the units that match; ``unit`` is the number of each word's unit."""
        size = len(self.words)
        at = np.minimum(np.searchsorted(self.words, found), size - 1)
        known = self.words[at] == found
        marked = np.zeros(units, bool)
        marked[unit[known & self.anchors[at]]] = True
        chosen = known & marked[unit]
        keys, times = np.unique(unit[chosen] * size + at[chosen], return_counts=True)
        of, word = keys // size, keys % size
        weight = times * self.idf[word]
        mass = np.bincount(of, weight**2, units)
        # a word that occurs several times weighs more than this, so the bound is safe
        chosen = ~known & marked[unit]
        least = np.bincount(unit[chosen], minlength=units) * self.other**2
        marked &= mass >= THRESHOLD**2 * 0.999 * (mass + least)
        chosen &= marked[unit]
        _, others, more = W.distinct(found[chosen], unit[chosen])
        norm = np.sqrt(mass + np.bincount(others, more.astype(float) ** 2, units) * self.other**2)
        kept = marked[of]
        of, word, weight = of[kept], word[kept], weight[kept]
        # every word of a unit meets the templates that hold it
        count = self.first[word + 1] - self.first[word]
        at = np.arange(count.sum()) + np.repeat(self.first[word] - (np.cumsum(count) - count), count)
        pairs, place = np.unique(np.repeat(of, count) * len(self.names) + self.template[at], return_inverse=True)
        cosine = np.bincount(place, np.repeat(weight, count) * self.weight[at], len(pairs))
        of, template = pairs // len(self.names), pairs % len(self.names)
        cosine = cosine / norm[of]
        good = cosine >= THRESHOLD
        of, template, cosine = of[good], template[good], cosine[good]
        order = np.lexsort((template, -cosine.round(12), of))
        of, template, cosine = of[order], template[order], cosine[order]
        best = np.append(True, of[1:] != of[:-1])[: len(of)]
        return of[best], template[best], cosine[best]

    def matches(self, column: pa.Array):
        """(text, words in the unit, template, cosine) of the matching lines, then of headers, then of whole texts."""
        found, owner, begin, _ = W.word_hashes(column, spans=True)
        nothing = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if not len(found):
            return [nothing] * 3
        ends, raw = W.utf8(column)
        texts = len(ends) - 1
        line = np.searchsorted(np.flatnonzero(raw == 10), begin)
        new = np.ones(len(found), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
        number = np.cumsum(new) - 1
        of, template, cosine = self.units(found, number, int(number[-1]) + 1)
        kinds = [(owner[new][of], np.bincount(number)[of], template, cosine)]
        # headers and whole texts of several lines; a header that is the whole text isn't taken twice
        lines = np.bincount(owner[new], minlength=texts)
        words = W.counts_by_text(owner, texts)
        stop = ends[1:].copy()
        data = raw.tobytes()
        for t in np.flatnonzero(lines > 1):
            header = HEADER.match(data, ends[t], ends[t + 1])
            stop[t] = header.end() if header else ends[t]
        several = lines[owner] > 1
        head = several & (begin < stop[owner])
        held = np.bincount(owner[head], minlength=texts)
        head &= (held < words)[owner]
        for inside in (head, several):
            of, template, cosine = self.units(found[inside], owner[inside], texts)
            kinds.append((of, np.bincount(owner[inside], minlength=texts)[of], template, cosine))
        return kinds


def _matched(sent):
    def run(batches):
        matcher = sent.value
        for batch in batches:
            for part in slices(batch, "__text"):
                column = part.column("__text")
                rows = part.num_rows
                words = W.counts_by_text(W.word_hashes(column)[1], rows)
                names: list = [None] * rows
                scores = np.zeros(rows)
                share = np.zeros(rows)
                for text, length, best, cosine in matcher.matches(column):
                    share = np.maximum(share, np.bincount(text, length, rows) / np.maximum(words, 1))
                    for t, b, c in zip(text, best, cosine):
                        if c > scores[t] + 1e-12:
                            names[t], scores[t] = matcher.names[b], c
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row"), pa.array(names, pa.string()), pa.array(scores), pa.array(share)],
                    names=["__row", "__own", "__score", "__share"],
                )

    return run


def matcher(files: DataFrame, text_col: str = "text", templates=TEMPLATES) -> Matcher:
    """Weights from all rows of ``files``; the driver gets one number per template word."""
    ready(files.sparkSession)
    words = vocabulary(templates)
    rows = files.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"))
    found = rows.mapInArrow(_frequencies(words), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in found}
    return Matcher(n.get(-1, 0), np.array([n.get(i, 0) for i in range(len(words))]), templates)


def directory(path: Column) -> Column:
    """What stands before the last slash; NULL for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(id, path, license, score, origin, license_dir) of every row.

    ``origin`` is ``own``, ``inherited`` (then ``license_dir`` is the directory it
    comes from and ``score`` the licence file's) or ``none``.
    """
    spark = ready(files.sparkSession)
    sent = spark.sparkContext.broadcast(matcher(files, text_col, templates))
    rows = files.select(
        F.struct(F.col(id_col).alias("id"), path.alias("path")).alias("__row"),
        F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"),
    )
    kind = rows.schema["__row"].dataType.simpleString()
    found = rows.mapInArrow(_matched(sent), f"__row {kind}, __own string, __score double, __share double")
    found = found.select(
        F.col("__row.id").alias("__id"), F.col("__row.path").alias("__path"), "__own", "__score", "__share",
        directory(F.col("__row.path")).alias("__dir"),
    )
    found = stored(found, "licenses")
    is_file = F.col("__path").rlike(FILE_NAMES) | (F.col("__share") >= FILE_SHARE)
    named = found.filter(F.col("__own").isNotNull() & F.col("__dir").isNotNull() & is_file).groupBy("__dir").agg(
        F.min_by(F.struct("__own", "__score"), F.struct((-F.col("__score")).alias("s"), F.col("__own").alias("o"))).alias("__of")
    )
    # one row per directory that needs a licence, then one per directory above it
    asking = found.filter(F.col("__own").isNull() & F.col("__dir").isNotNull()).select("__dir").distinct()
    parts = F.split("__dir", "/")
    above = asking.select(
        "__dir",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("__above"),
    )
    nearest = (
        above.join(named.select(F.col("__dir").alias("__above"), "__of"), "__above")
        .groupBy("__dir")
        .agg(F.max_by(F.struct("__above", "__of"), F.length("__above")).alias("__from"))
    )
    return found.join(nearest, "__dir", "left").select(
        F.col("__id").alias(id_col),
        F.col("__path").alias("path"),
        F.coalesce("__own", "__from.__of.__own").alias("license"),
        F.when(F.col("__own").isNull() & F.col("__from").isNotNull(), F.col("__from.__of.__score")).otherwise(F.col("__score")).alias("score"),
        F.when(F.col("__own").isNotNull(), "own").when(F.col("__from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("__own").isNull(), F.col("__from.__above")).alias("license_dir"),
    )
