"""Licence scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them. Column expressions only.

A text's words (letters and digits, lower-case) give shingles of SHINGLE words. A template of m shingles is looked for in windows of twice W shingles
that start every W, where W is the least power of two that is not below m: every run of m shingles lies whole in a window, and is
a quarter of it at least. Each window has HASHES bands of one row. A window that holds 80% of a template's shingles shares at least a fifth of the union, so that it
misses all bands with a probability of (1 - 0.2) ** HASHES, 2e-5 at most. A band can only match where the window holds the shingle that is the
template's own minimum, so texts and windows without any such shingle are passed over first, without a loss. Retrieved
windows are verified by the exact share of the template's shingles that they hold.

A template of fewer than SHINGLE words is one shingle of as many words as it has, and texts are then looked at by such shingles too.

Cases: null and empty texts have no shingle, and neither has a text of fewer words than a shingle. A text of any length is looked at whole, in one task. Rows that repeat a doc_id give one
result together; null doc_ids too. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SHINGLE, CONTAINED, HASHES = 5, 0.8, 48

#: Lines and opening passages by which licences are declared, and whole licences.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "rights-reserved": "All rights reserved.",
    # Whole licences and clauses.
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        'specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY '
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "GPL-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details."
    ),
    "Apache-2.0-warranty": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
        "License for the specific language governing permissions and limitations under the License."
    ),
}


def _words(df: DataFrame, text: str) -> DataFrame:
    """df with _words, the words of a text, and a row's number, which keeps conditions above this projection: pushed below, they would split the text anew for each shingle."""
    split = F.split(F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", F.lit(" "))), " ")
    return df.withColumns({"_words": split, "_row": F.monotonically_increasing_id()})


def _shingles(n: int) -> Column:
    """The hashes of the shingles of n words of _words in order; none of shorter texts."""
    parts = F.transform(F.sequence(F.lit(0), F.size("_words") - n), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(n)]))
    return F.when(F.size("_words") >= n, parts).otherwise(F.array().cast("array<bigint>"))


def _places(signs: Column, w: Column) -> Column:
    """Starts of the windows of 2w shingles that hold a sign: the one that starts at or before it, and the one before that."""
    at = F.filter(F.transform("s", lambda x, i: F.when(F.array_contains(signs, x), i)), lambda i: i.isNotNull())
    starts = F.flatten(F.transform(at, lambda i: F.array((F.floor(i / w) * w).cast("int"), (F.floor(i / w) * w - w).cast("int"))))
    return F.filter(F.array_distinct(starts), lambda i: i >= 0)


def bands(window: Column) -> Column:
    """One key for each hash function: its number and its least value over a window."""
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.xxhash64(i, F.array_min(F.transform(window, lambda x: F.xxhash64(x, i)))))


def _templates(spark: SparkSession, templates: dict[str, str]) -> list[tuple]:
    """(name, w, shingles, bands, each band's shingle, words of a shingle) of each template; as many rows as templates are given. A template of fewer than SHINGLE words is one shingle of its own length."""
    df = _words(spark.createDataFrame(list(templates.items()), "name string, text string"), "text").withColumn("n", F.least(F.lit(SHINGLE), F.size("_words")))
    own = None
    for n in range(1, SHINGLE + 1):
        own = F.when(F.col("n") == n, _shingles(n)) if own is None else own.when(F.col("n") == n, _shingles(n))
    df = df.withColumn("s", F.array_distinct(own))
    least = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.array_min(F.transform("s", lambda x: F.struct(F.xxhash64(x, i).alias("h"), x.alias("x"))))["x"])
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size("s"), F.lit(2))))).cast("int")
    return [tuple(r) for r in df.select("name", width.alias("w"), "s", bands(F.col("s")).alias("b"), least.alias("least"), "n").collect()]


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _held(d: DataFrame, known: list[tuple], contained: float) -> DataFrame:
    """(doc_id, licence, start, containment) of the windows of d (doc_id, s) that hold a template."""
    # Each width of windows with its templates' signs and bands; as many as there are powers of two.
    widths = [{"w": w, "signs": sorted({x for t in known if t[1] == w for x in t[4]}), "keys": sorted({x for t in known if t[1] == w for x in t[3]})} for w in sorted({t[1] for t in known})]
    d = d.withColumn("at", F.explode(_constant(widths, "array<struct<w: int, signs: array<bigint>, keys: array<bigint>>>"))).where(F.arrays_overlap("s", "at.signs"))
    win = d.withColumn("start", F.explode(_places(F.col("at.signs"), F.col("at.w"))))
    win = win.select("doc_id", "start", "at", F.slice("s", F.col("start") + 1, 2 * F.col("at.w")).alias("s"))
    win = win.withColumn("key", F.explode(F.array_intersect(bands(F.col("s")), F.col("at.keys")))).withColumn("w", F.col("at.w")).drop("at")
    index = d.sparkSession.createDataFrame([(k, t[1], t[0], t[2]) for t in known for k in sorted(set(t[3]))], "key long, w int, licence string, of array<bigint>")
    hit = win.join(F.broadcast(index), ["key", "w"])  # as many rows as templates times HASHES
    hit = hit.withColumn("containment", F.size(F.array_intersect("of", "s")) / F.size("of")).where(F.col("containment") >= contained)
    return hit.groupBy("doc_id", "licence", "start").agg(F.max("containment").alias("containment"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, licence, containment, windows, first_window) for each text that holds a template (a name and its text): the best containment, the windows that reach `contained` and the first one's start."""
    known = _templates(docs.sparkSession, templates or TEMPLATES)
    sizes = sorted({t[5] for t in known})
    signs = {n: _constant(sorted({x for t in known if t[5] == n for x in t[4]}), "array<bigint>") for n in sizes}
    d = _words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text").drop("text")
    d = d.select("doc_id", *[_shingles(n).alias(f"s{n}") for n in sizes], F.monotonically_increasing_id().alias("_row"))
    some = F.lit(False)
    for n in sizes:
        some |= F.arrays_overlap(f"s{n}", signs[n])
    d = cut(d.where(some & (F.col("_row") >= 0)).drop("_row"))
    found = None
    for n in sizes:
        part = _held(d.select("doc_id", F.col(f"s{n}").alias("s")), [t for t in known if t[5] == n], contained)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "licence").agg(F.max("containment").alias("containment"), F.count(F.lit(1)).alias("windows"), F.min("start").cast("long").alias("first_window"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
