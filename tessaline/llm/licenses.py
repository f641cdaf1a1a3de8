"""License scans: lines, paragraphs and whole texts compared to license templates.

A unit (a line, a run of lines that have words, or a text as a whole) and a template are
normalised to lower-case letters and digits; their similarity is the Dice coefficient of
their word bigrams, repeats counted: 2 * common / (bigrams of both). It can only reach the
threshold t if the number of bigrams of one is within t / (2 - t) times that of the other,
so every template is listed under the sizes it can match and units are joined by their
size. Of a template's bigrams a match must share so many that it holds one of a few; units
without any of these few are left out before that. Only column functions are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline import storage

SIMILARITY = 0.8

#: The usual short notices, paragraphs and full texts of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "Apache-2.0-disclaimer": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


def _normal(text: Column) -> Column:
    """Lower-case ASCII words of letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _pairs(unit: Column) -> Column:
    """The hashes of a unit's word bigrams."""
    # the outer transform binds the words, which the inner one would split off anew for each bigram
    cut = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i)))).otherwise(F.array().cast("array<bigint>"))
    return F.get(F.transform(F.array(F.split(unit, " ")), cut), F.lit(0))


def _bigrams(templates: dict[str, str], similarity: float) -> tuple[list[tuple], set[tuple[str, str]]]:
    """A row (template, size, low, high, first, second, k) for each bigram that a template has k times, and the bigrams of which every match has one.

    low and high bound the number of a match's bigrams. A match shares at least
    similarity / 2 * (low + size) of them, so it can't lack all of any size less that plus
    one; those of the longest words are taken, as the rarest in other texts.
    """
    rows, needed, ratio = [], set(), similarity / (2 - similarity)
    for template, text in templates.items():
        words = re.findall("[a-z0-9]+", text.lower())
        pairs = sorted(pairwise(words), key=lambda p: (-len(p[0]) - len(p[1]), p))
        size = len(pairs)
        low, high = max(1, math.ceil(size * ratio - 1e-9)), math.floor(size / ratio + 1e-9)
        rows += [(template, size, low, high, *pair, k) for pair, k in Counter(pairs).items()]
        needed |= set(pairs[: size - math.ceil(similarity / 2 * (low + size) - 1e-9) + 1])
    return rows, needed


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_units, n_matches, licenses, best_dice of each row of docs.

    Units are the lines with a bigram; if there are several lines, the whole text; and if
    that has several paragraphs (lines with words between others), each of several lines. A
    match is a unit with a template at the threshold or above: each unit counts for its
    most similar template, the first by name of equals. licenses are the matched names in
    order, comma-joined; best_dice is null without a match. A null or empty text has no
    units. Repeated ids and rows each give a row; a null id stays null. Other columns are
    not read. An empty table gives no rows, and without templates nothing matches.

    Units are judged where they are; only those of a size that some template can match and
    with a bigram that it needs leave their row. What is broadcast are the templates.
    """
    spark = docs.sparkSession
    rows, needed = _bigrams(templates, similarity)
    table = spark.createDataFrame(rows, "template string, size int, low int, high int, first string, second string, times int")
    sizes = sorted({n for _, _, low, high, *_ in rows for n in range(low, high + 1)})
    possible = F.array(*(F.lit(n) for n in sizes)).cast("array<int>")
    anchors = F.array(*(F.xxhash64(F.lit(a), F.lit(b)) for a, b in sorted(needed))).cast("array<bigint>")
    lines = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).alias("doc_id"), _normal_lines(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    lines = lines.select("row_no", "doc_id", F.split("norm", "\n", -1).alias("lines"), F.split(F.regexp_replace("norm", "^\n+|\n+$", ""), "\n\n+", -1).alias("parts"))
    none = F.array().cast("array<string>")
    flat = lambda unit: F.replace(unit, F.lit("\n"), F.lit(" "))
    blocks = F.when(F.size("parts") > 1, F.transform(F.filter("parts", lambda p: F.contains(p, F.lit("\n"))), flat)).otherwise(none)
    whole = F.when(F.size("lines") > 1, F.array(F.array_join(F.filter("lines", lambda x: x != ""), " "))).otherwise(none)
    units = F.transform(F.concat("lines", blocks, whole), lambda u: F.struct(u.alias("unit"), (F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))).alias("n")))
    counted = lines.select("row_no", "doc_id", units.alias("units")).select("row_no", "doc_id", F.size(F.filter("units", lambda u: u["n"] > 0)).cast("long").alias("n_units"), F.filter("units", lambda u: F.array_contains(possible, u["n"])).alias("units"))
    judged = counted.select("row_no", "doc_id", "n_units", F.posexplode_outer("units").alias("no", "u")).select("row_no", "doc_id", "n_units", "no", "u.n", _pairs(F.col("u.unit")).alias("pairs"))
    held = F.coalesce(F.arrays_overlap("pairs", anchors), F.lit(False))
    judged = storage.save(judged.where(held | F.coalesce(F.col("no") == 0, F.lit(True))).select("row_no", "doc_id", "n_units", "no", "n", F.when(held, F.col("pairs")).alias("pairs")), "units")
    own = judged.select("row_no", "no", "n", F.explode("pairs").alias("pair")).groupBy("row_no", "no", "n", "pair").agg(F.count("*").alias("k"))
    marks = table.select("template", "size", "low", "high", "times", F.xxhash64("first", "second").alias("pair"))
    shared = own.join(F.broadcast(marks), "pair").where("n BETWEEN low AND high").groupBy("row_no", "no", "n", "template", "size").agg(F.sum(F.least("k", F.col("times").cast("long"))).alias("common"))
    near = shared.withColumn("dice", 2 * F.col("common") / (F.col("n") + F.col("size"))).where(F.col("dice") >= similarity)
    best = near.groupBy("row_no", "no").agg(F.min(F.struct((-F.col("dice")).alias("least"), "template", "dice")).alias("b"))
    found = best.groupBy("row_no").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("b.template")), ",").alias("licenses"), F.round(F.max("b.dice"), 6).alias("best_dice"))
    found = storage.save(found, "matches")
    once = judged.where("no IS NULL OR no = 0").select("row_no", "doc_id", "n_units")
    out = once.join(storage.broadcast_if_small(found), "row_no", "left")
    return out.select("doc_id", "n_units", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"), "best_dice")


def _normal_lines(text: Column) -> Column:
    """_normal() of every line, line breaks kept."""
    flat = F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " ")
    return F.regexp_replace(flat, "(?m)^ | $", "")
