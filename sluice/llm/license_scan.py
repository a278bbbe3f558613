"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are lower-cased, freed of punctuation and cut into words and 5-word
shingles. Templates fall into classes by size: class c holds those of 2**(c-1)+1 to 2**c
shingles, and its windows are 2**(c+1) shingles long at every 2**c-th shingle, so each
occurrence of a template lies whole in some window. A window that holds at least `CONTAINED`
of a template's shingles then has a Jaccard similarity of at least `least_similarity()` with
it; with `BANDS` bands of one MinHash value each the chance that no band collides is below
`miss_probability()`, 1 in 20,000. Retrieved templates are verified by exact containment.

A band collides only where the window holds the very shingle that gives the template its minimum
in that band. Bands are therefore computed only for the windows around such shingles (`BANDS` a
template at most, its sketch); all other windows cannot collide, so exactly the pairs that the
bands retrieve are verified. The list of templates is fixed and small; it is part of the plan as
literals, so the scan needs no join, no shuffle and no Python.

A template that another one covers (its shingles are in the other to `CONTAINED` at least: the
notices of neighbouring versions, the two-clause in the three-clause BSD text) is not reported
where the other matches the document better, or as well and is larger.

The list holds the operative texts and usual notices of common licenses, not the whole of the
long ones (Apache, GPL, MPL and Creative Commons are known by their notices), and notices of under
five words only as SPDX tags, which are reported apart.

Defined results: null, empty and short texts match nothing (empty list); very long texts are
scanned whole; a text matches a template once, with its best containment; ties between licenses
are all reported, in order of their names; repeated rows each get their own row; a null doc_id is
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a shingle, and the share of a template's shingles that a window must hold.
SHINGLE, CONTAINED = 5, 0.8
BANDS = 48
#: Punctuation that is dropped.
DROPPED = ".,;:()\"'!*#$%&|<>[]{}/"
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: License texts and notices, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _GRANT),
    (
        "MIT",
        _GRANT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)
_MATCH = "array<struct<i:int,containment:double>>"


def least_similarity() -> float:
    """The least Jaccard similarity of a template and a window that holds CONTAINED of its shingles."""
    # A template has over a quarter as many shingles as its window.
    return (CONTAINED / 4) / (1 + (1 - CONTAINED) / 4)


def miss_probability() -> float:
    """The greatest chance that a window to be found shares no band."""
    return (1 - least_similarity()) ** BANDS


def size_class(n: int) -> int:
    """The class of a template of n shingles."""
    return math.ceil(math.log2(n))


def words(text: Column) -> Column:
    """Lower-cased words without punctuation; null has none."""
    clean = F.translate(F.lower(F.coalesce(text, F.lit(""))), DROPPED, "")
    return F.filter(F.split(clean, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(word_array: Column) -> Column:
    """A hash of each run of SHINGLE words, in order."""
    last = F.size(word_array) - SHINGLE
    hashed = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(word_array, i, SHINGLE)))
    return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _least(window: Column) -> Column:
    """The least hash of the window's shingles in each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(window, lambda h: F.xxhash64(h, k))))


def _named(least: Column) -> Column:
    """The band values with the band's number, so that they are compared within their band."""
    return F.transform(least, lambda v, k: F.xxhash64(k, v))


def bands(window: Column) -> Column:
    """One MinHash value a band."""
    return _named(_least(window))


@dataclass(frozen=True)
class Template:
    """A template's license, shingles, band values, the shingles that give them, and the numbers of the templates that cover it."""

    license: str
    shingles: list[int]
    bands: list[int]
    sketch: list[int]
    covers: list[int]


def _prepared(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> list[Template]:
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "i int, name string, text string")
    own = df.select("i", "name", words(F.col("text")).alias("w")).select("i", "name", F.array_distinct(shingles(F.col("w"))).alias("s"))
    own = own.select("*", _least(F.col("s")).alias("m"))
    giving = F.array_distinct(F.flatten(F.transform("m", lambda v, k: F.filter("s", lambda h: F.xxhash64(h, k) == v))))
    rows = sorted(own.select("i", "name", "s", _named(F.col("m")).alias("b"), giving.alias("g")).collect(), key=lambda r: r["i"])
    if any(not r["s"] for r in rows):
        raise ValueError(f"a template needs {SHINGLE} words at least")
    sets = [set(r["s"]) for r in rows]
    covers = [[j for j, t in enumerate(sets) if j != i and len(s & t) >= CONTAINED * len(s)] for i, s in enumerate(sets)]
    return [Template(r["name"], list(r["s"]), list(r["b"]), list(r["g"]), c) for r, c in zip(rows, covers, strict=True)]


def _longs(values: list[int]) -> Column:
    return F.expr(f"cast(array({', '.join(f'{v}L' if v > -(2**63) else '(-9223372036854775807L - 1L)' for v in values)}) as array<bigint>)")


def _matched(c: int, templates: list[tuple[int, Template]]) -> Column:
    """The templates of one class that the windows around a row's `hits` hold, from its shingles `h`."""
    stride, length = 1 << c, 2 << c
    known = F.array(*[F.struct(F.lit(i).alias("i"), _longs(t.shingles).alias("s"), _longs(t.bands).alias("b")) for i, t in templates])
    # A position lies in the window that starts at its stride and in the one before.
    at = F.transform("hits", lambda i: (i / stride).cast("int"))
    starts = F.array_distinct(F.concat(at, F.transform(at, lambda w: F.greatest(F.lit(0), w - 1))))
    windows = F.transform(starts, lambda w: F.slice("h", w * stride + 1, length))
    looked = F.transform(windows, lambda w: F.struct(w.alias("w"), bands(w).alias("b")))

    def verified(window: Column) -> Column:
        retrieved = F.filter(known, lambda t: F.arrays_overlap(t["b"], window["b"]))
        held = F.transform(retrieved, lambda t: F.struct(t["i"].alias("i"), (F.size(F.array_intersect(t["s"], window["w"])) / F.size(t["s"])).alias("containment")))
        return F.filter(held, lambda m: m["containment"] >= CONTAINED)

    return F.flatten(F.transform(looked, verified))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, matches (array of license and containment, by name), licenses (their names, comma-joined), and spdx_tags (the identifiers that the text declares)."""
    prepared = list(enumerate(_prepared(docs.sparkSession, templates)))
    sketch = sorted({h for _, t in prepared for h in t.sketch})
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(docs[text], F.lit("")), F.lit(r"SPDX-License-Identifier:[\x20\t]*([A-Za-z0-9.+-]+)"), F.lit(1))))
    # Each array is a column of its own before a lambda refers to it: within a lambda it would be made anew for each element.
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), tags.alias("tags"), words(docs[text]).alias("w")).select("doc_id", "tags", shingles(F.col("w")).alias("h"))
    # Positions of shingles at which some band can collide.
    hits = F.filter(F.transform(F.col("h"), lambda h, i: F.when(h.isin(sketch), i)), lambda i: i.isNotNull())
    base = base.select("doc_id", "tags", "h", hits.alias("hits"))
    # Few rows have any; the others carry no shingles further.
    base = base.select("doc_id", "tags", F.when(F.size("hits") > 0, F.col("h")).alias("h"), "hits")
    classes = sorted({size_class(len(t.shingles)) for _, t in prepared})
    found = F.concat(*[_matched(c, [(i, t) for i, t in prepared if size_class(len(t.shingles)) == c]) for c in classes])
    base = base.select("doc_id", "tags", F.when(F.size("hits") > 0, found).otherwise(F.array().cast(_MATCH)).alias("m"))
    best = F.transform(F.array_distinct(F.transform("m", lambda m: m["i"])), lambda i: F.struct(i.alias("i"), F.array_max(F.transform(F.filter("m", lambda m: m["i"] == i), lambda m: m["containment"])).alias("containment")))
    base = base.select("doc_id", "tags", best.alias("m"))

    names = F.expr("array(" + ", ".join(f"'{t.license}'" for _, t in prepared) + ")")
    sizes = F.expr("array(" + ", ".join(str(len(t.shingles)) for _, t in prepared) + ")")
    covers = F.expr("array(" + ", ".join(f"cast(array({', '.join(map(str, t.covers))}) as array<int>)" for _, t in prepared) + ")")

    def better(o: Column, m: Column) -> Column:
        larger = F.get(sizes, o["i"]) > F.get(sizes, m["i"])
        return F.array_contains(F.get(covers, m["i"]), o["i"]) & ((o["containment"] > m["containment"]) | ((o["containment"] == m["containment"]) & larger))

    left = F.filter("m", lambda m: ~F.exists("m", lambda o: better(o, m)))
    base = base.select("doc_id", "tags", F.transform(left, lambda m: F.struct(F.get(names, m["i"]).alias("license"), m["containment"].alias("containment"))).alias("m"))
    by_name = F.array_sort(F.array_distinct(F.transform("m", lambda m: m["license"])))
    matches = F.transform(by_name, lambda n: F.struct(n.alias("license"), F.array_max(F.transform(F.filter("m", lambda m: m["license"] == n), lambda m: m["containment"])).alias("containment")))
    return base.select("doc_id", matches.alias("matches"), F.array_join(by_name, ",").alias("licenses"), F.col("tags").alias("spdx_tags"))
