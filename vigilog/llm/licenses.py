"""License scan with DataFrame functions only.

Texts and templates are sequences of words (ASCII letters and digits, in lower case), and
their sets are 3-word shingles. A text is read in overlapping windows of ``WINDOW`` words, one
at every ``STEP`` words. A window's MinHash signature comes from one permutation: the hashes of
its shingles fall by their first bits into ``2 ** BAND_BITS`` bands, and the least hash of each
band is kept. A template has the signatures of its own windows, one at every word, or of
itself where it is shorter. A window retrieves the templates that share a minimum with it.

Guarantee: a template shingle in a window of 30 is the minimum of its band unless one of the 29
others falls below it there, which has a probability of at most 29 / 2 / 512 = 0.029. A notice
of 5 words, the shortest template, has 3 shingles in a window and is missed with probability
0.029 ** 3 = 2.4e-5; each further shingle divides that by 35. Every notice of up to 17 words lies in
one window as a whole, and of a longer one some window holds 14 shingles or more.

Every retrieved template is then verified exactly, beside the window that retrieved it: a
passage of at most ``STRETCH`` times the template's shingles must hold the share ``CONTAINED`` of
them. Shingles scattered over a text are no notice. The passage with the most shingles
counts, the first of equal ones.

The templates are a small list of the caller's; what is derived from them is bounded by
their length, is a constant of the plan, and is broadcast. Only shingles of documents with a
retrieving window are written, and only those around such windows are shuffled, in blocks.

Defined results: a null, empty or short text finds nothing and has no row; repeated rows
are found repeatedly; a template of fewer than three words can't be found and raises. A
table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilog.llm.batches import column
from vigilog.llm.quality_rules import let
from vigilog.session import stored

SHINGLE = 3
WINDOW = 32
STEP = 16
BAND_BITS = 9
CONTAINED = 0.8
STRETCH = 1.25
SPAN = WINDOW - SHINGLE + 1  # shingles of a window

# The wording of public license notices and license texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib-text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))


def _shingles(words: Column) -> Column:
    """Hashes of the shingles at each place of a let-bound array of words."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(F.lower(F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, SHINGLE)]))))


def _minima(window: Column) -> Column:
    """The least hash of each band: hashes in order, the first of each run of equal first bits."""
    band = lambda h: F.shiftrightunsigned(h, 64 - BAND_BITS)
    return let(F.sort_array(window), lambda s: F.filter(s, lambda h, i: ~band(h).eqNullSafe(band(F.get(s, i - 1)))))


def template_tables(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[int], int]:
    """Rows ``license``, ``shingles`` (distinct), ``reach`` (shingles of the longest passage) and ``minima``
    of all windows; all minima; and the longest reach."""
    rows = spark.createDataFrame(list(templates), "license string, text string").withColumn("own", let(_words(F.col("text")), _shingles))
    if not rows.filter(F.size("own") == 0).isEmpty():
        raise ValueError(f"a template needs {SHINGLE} words")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("own") - (SPAN - 1), F.lit(1))), lambda i: F.slice("own", i, SPAN))
    rows = rows.select(
        "license",
        F.array_distinct("own").alias("shingles"),
        F.ceil(F.size("own") * STRETCH).cast("int").alias("reach"),
        F.array_distinct(F.flatten(F.transform(windows, _minima))).alias("minima"),
    )
    minima = [r[0] for r in rows.select(F.explode("minima").alias("m")).distinct().collect()]
    return rows, minima, rows.agg(F.max("reach")).first()[0]


def _passages(hits: Column, reach: Column, until: Column) -> Column:
    """For each hit before ``until`` the passage of ``reach`` shingles that begins there: how many distinct ones it holds, and its place."""

    def passage(x, i):
        inside = F.filter(F.slice(hits, i + 1, reach), lambda y: y["at"] < x["at"] + reach)
        return let(inside, lambda n: F.struct(F.size(F.array_distinct(F.transform(n, lambda y: y["h"]))).alias("n"), (-x["at"]).alias("begin"), (F.array_max(F.transform(n, lambda y: y["at"])) + SHINGLE - 1).alias("end")))

    return F.transform(F.filter(hits, lambda y: y["at"] < until), passage)


def licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document and template found in it: ``doc_id``, ``license``, ``n_matched``
    of ``n_shingles``, ``containment``, and ``first_word``, ``last_word`` (from 0) of the passage."""
    known, minima, longest = template_tables(docs.sparkSession, templates)
    words = docs.select(column(docs, id_column).alias("doc_id"), _words(F.coalesce(column(docs, text_column).cast("string"), F.lit(""))).alias("words"))
    # Both arrays are handed on by a generator of one row: no later use of them is moved below it and computed again.
    hashed = words.select("doc_id", F.explode(F.array(let(F.col("words"), _shingles))).alias("shingles"))
    begins = F.sequence(F.lit(0), F.greatest(F.size("shingles") - (SPAN - STEP) - 1, F.lit(0)), F.lit(STEP))
    windows = F.transform(begins, lambda b: F.struct(b.alias("begin"), F.filter(_minima(F.slice("shingles", b + 1, SPAN)), lambda h: h.isin(minima)).alias("shared")))
    met = hashed.withColumn("windows", F.explode(F.array(F.filter(windows, lambda w: F.size(w["shared"]) > 0)))).filter(F.size("windows") > 0)
    met = stored(met.withColumn("row", F.monotonically_increasing_id()))
    # Passages are told apart by the block of STEP shingles in which they begin, so each is looked at once.
    block = lambda place: F.floor(F.greatest(place, F.lit(0)) / STEP).cast("int")
    blocks = lambda begin, reach: F.sequence(block(begin - reach), block(begin + SPAN - 1))
    shared = known.select("license", "reach", F.explode("minima").alias("key"))
    keys = met.select("row", F.inline("windows")).select("row", "begin", F.explode("shared").alias("key"))
    keys = keys.join(F.broadcast(shared), "key").select("row", "license", "begin", "reach").distinct()
    found = keys.select("row", "license", F.explode(blocks(F.col("begin"), F.col("reach"))).alias("block")).distinct()
    places = met.select("doc_id", "row", "shingles", F.array_distinct(F.flatten(F.transform("windows", lambda w: blocks(w["begin"], F.lit(longest))))).alias("blocks"))
    near = places.select("doc_id", "row", F.inline(F.transform("blocks", lambda x: F.struct(x.alias("block"), F.slice("shingles", x * STEP + 1, STEP + longest).alias("near")))))
    pairs = found.join(near, ["row", "block"]).join(F.broadcast(known.select("license", "shingles", "reach")), "license")
    begin = F.col("block") * STEP
    hits = F.filter(F.transform("near", lambda h, i: F.struct((begin + i).alias("at"), h.alias("h"))), lambda x: F.array_contains("shingles", x["h"]))
    best = pairs.withColumn("best", F.explode(F.array(let(hits, lambda x: F.array_max(_passages(x, F.col("reach"), begin + STEP))))))
    verified = best.filter(F.col("best.n") >= contained * F.size("shingles"))
    whole = verified.groupBy("row", "doc_id", "license").agg(F.max("best").alias("best"), F.first(F.size("shingles")).alias("size"))
    return whole.select(
        "doc_id",
        "license",
        F.col("best.n").cast("long").alias("n_matched"),
        F.col("size").cast("long").alias("n_shingles"),
        (F.col("best.n") / F.col("size")).alias("containment"),
        (-F.col("best.begin")).cast("long").alias("first_word"),
        F.col("best.end").cast("long").alias("last_word"),
    )
