"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WORD, content_key, durable, tokens

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Public license statements that are looked for (fixed values): statements, short licenses whole, titles and notices of long ones.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-license": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-license": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "BSD-2-Clause-license": _BSD + _DISCLAIMER,
    "BSD-3-Clause-license": _BSD + _NAMES + _DISCLAIMER,
    "BSD-3-Clause": _NAMES,
    "Apache-2.0-title": "Apache License Version 2.0, January 2004",
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3",
    "GPL-notice": "terms of the GNU General Public License as published",
    "LGPL-2.1-title": "LESSER GENERAL PUBLIC LICENSE Version 2.1",
    "LGPL-3.0-title": "LESSER GENERAL PUBLIC LICENSE Version 3",
    "LGPL-notice": "terms of the GNU Lesser General Public License as published",
    "AGPL-3.0-title": "AFFERO GENERAL PUBLIC LICENSE Version 3",
    "AGPL-notice": "terms of the GNU Affero General Public License as published",
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0-title": "CC0 1.0 Universal",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: Words of a shingle; least part of a template's shingles in a window; chance that all bands miss a window that holds it.
WIDTH, LEAST, MISS = 3, 0.8, 1e-6


def shingles(words: str, width: int = WIDTH) -> str:
    """SQL: hashes of an array's shingles; fewer words are one shingle, none have none."""
    return f"CASE WHEN size({words}) = 0 THEN cast(array() as array<bigint>) ELSE transform(sequence(1, greatest(1, size({words}) - {width - 1})), i -> xxhash64(array_join(slice({words}, i, {width}), ' '))) END"


def bands(cls: int, sizes: list[int], least: float = LEAST) -> int:
    """One-row bands after which a window of the class misses templates of so many shingles with probability MISS at most."""

    def needed(n):
        both = max(1, math.ceil(least * n - 1e-9))
        window = max(2 * cls - WIDTH + 1, both)
        likeness = both / (window + n - both)
        return 1 if likeness >= 1 else math.ceil(math.log(MISS) / math.log(1 - likeness))

    return max(map(needed, sizes))


def minima(sh: str, bands: str) -> str:
    """SQL: the bands' minima over a set of hashes."""
    return f"transform(sequence(1, {bands}), b -> array_min(transform({sh}, h -> xxhash64(h, b))))"


def prepared(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, class (the power of two that holds its words), distinct shingles; those without words are gone."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").withColumn("words", tokens(F.col("text"), NOT_WORD)).filter("size(words) > 0")
    size = F.greatest(F.lit(8), F.pow(2, F.ceil(F.log2(F.size("words").cast("double"))))).cast("int")
    return rows.select("license", size.alias("cls"), F.array_distinct(F.expr(shingles("words"))).alias("sh"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, n_windows, containment: templates of which a window holds at least that part.

    Windows of 2c words start every c words, for each class c (8, 16, ...) of template lengths,
    so a statement lies whole in a window. Each one-row band collides with the probability of their
    likeness, which the shortest template of a class makes least: bands() takes so many that all
    miss with MISS at most. Only windows with a template's shingle are hashed; no other can hold one. Documents without a
    match have no row, null and empty texts none; repeated rows count once; the templates'
    number and length bound what is broadcast.
    """
    spark = docs.sparkSession
    known = durable(prepared(spark, TEMPLATES if templates is None else templates)).collect()
    wanted = sorted({h for r in known for h in r["sh"]})
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not wanted:
        return spark.createDataFrame([], f"doc_id {kind}, license string, n_windows long, containment double")
    rows = docs.select("doc_id", content_key(F.col("text")).alias("key"), tokens(F.col("text"), NOT_WORD).alias("words")).filter("size(words) > 0")
    rows = rows.select("doc_id", "key", F.expr(shingles("words")).alias("sh"))
    small = spark.createDataFrame([(wanted,)], "wanted array<bigint>")
    rows = rows.crossJoin(F.broadcast(small)).filter(F.arrays_overlap("sh", "wanted"))  # one row: the templates' shingles
    at = F.expr(f"filter(transform(sh, (h, i) -> if(h IN ({', '.join(f'{h}L' for h in wanted)}), i, -1)), i -> i >= 0)")  # a hash set
    rows = durable(rows.select("doc_id", "key", "sh", at.alias("at")).dropDuplicates(["doc_id", "key"]))
    sizes: dict[int, list[int]] = {}
    for r in known:
        sizes.setdefault(r["cls"], []).append(len(r["sh"]))
    many = {c: bands(c, n, least) for c, n in sorted(sizes.items())}
    classes = F.array(*map(F.lit, many))
    of = F.expr("CASE cls " + " ".join(f"WHEN {c} THEN {n}" for c, n in many.items()) + " END")
    wins = rows.withColumn("cls", F.explode(classes)).withColumn("win", F.explode(F.expr("array_distinct(flatten(transform(at, i -> array(cast(floor(i / cls) as int), cast(floor(i / cls) as int) - 1))))"))).filter("win >= 0")
    wins = wins.select("doc_id", "key", "cls", "win", F.expr(f"slice(sh, win * cls + 1, 2 * cls - {WIDTH - 1})").alias("sh"))
    own = [(c, sorted({h for r in known if r["cls"] == c for h in r["sh"]}), min(math.ceil(least * n - 1e-9) for n in ns)) for c, ns in sorted(sizes.items())]
    own = F.broadcast(spark.createDataFrame(own, "cls int, own array<bigint>, need int"))
    wins = wins.join(own, "cls").filter("size(array_intersect(sh, own)) >= need").drop("own", "need")  # no other window can hold a template
    banded = wins.withColumn("bands", of).select("*", F.posexplode(F.expr(minima("sh", "bands"))).alias("band", "v"))
    table = spark.createDataFrame([(r["license"], r["cls"], r["sh"]) for r in known], "license string, cls int, t array<bigint>")
    table = table.withColumn("bands", of).select("license", "cls", "t", F.posexplode(F.expr(minima("t", "bands"))).alias("band", "v"))
    met = banded.join(F.broadcast(table), ["cls", "band", "v"])
    met = met.withColumn("part", F.size(F.array_intersect("sh", "t")) / F.size("t")).filter(F.col("part") >= least)
    return met.groupBy("doc_id", "key", "license").agg(F.countDistinct("win").alias("n_windows"), F.max("part").alias("containment")).drop("key")
