"""License scans. Native: DataFrame operations only.

Texts become lower-case words, and these five-word shingles, as 64-bit hashes. A text without any shingle
of any template can't contain one and ends here, in the scan. The others are cut into overlapping
windows, for templates of up to c shingles of 2c shingles every c, so that a copy always lies whole in one.
MinHash bands of one row retrieve templates for windows: a window that holds 0.8 of a template has a
Jaccard similarity of 0.19 to it at least, so all ``BANDS`` bands miss it with a chance below 2 in a
million. Exact containment of the template's shingles in the window then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64

# Notices and short licenses in full, in the wording of their publishers.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Released under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}


def with_shingles(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with hashes: those of the five-word shingles in order; texts of fewer words have none.

    Words and hashes come out of one-element explodes, so that the optimizer doesn't put their
    expressions into the lambda and filters that use them and work them out again and again.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    rows = rows.withColumn("_words", F.explode(F.array(words))).drop(text_col)
    hashed = F.transform(F.sequence(F.lit(0), F.size("_words") - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col("_words"), i + t) for t in range(SHINGLE)]))
    hashed = F.when(F.size("_words") >= SHINGLE, hashed).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("hashes", F.explode(F.array(hashed))).drop("_words")


def _low(hashes: Column, band: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))


def _bands(hashes: Column, bands: int) -> Column:
    """One minimum hash for each band."""
    return F.array(*[_low(hashes, b) for b in range(bands)])


def template_table(spark, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(license, template, size class, shingles): a fixed, small table. Templates have five words at least."""
    rows = [(name, f"{name}/{i}", text) for name, texts in templates.items() for i, text in enumerate(texts)]
    table = with_shingles(spark.createDataFrame(rows, "license string, template string, text string"), "text").withColumn("shingles", F.array_distinct("hashes"))
    size = F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles").cast("double")))).cast("int")
    return table.filter(F.size("shingles") > 0).select("license", "template", size.alias("class"), "shingles")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """Licenses that documents contain: one row (id, license, containment, places) for each pair.

    containment is that of the best matched template; places counts the windows that hold one. In one
    window a template gives way to a better one that explains all its shingles found there. Null,
    empty and short texts contain none; texts of any length are scanned whole. Rows repeated with one id count
    together, equal windows once; a null id is an id of its own. The order of ties doesn't matter, as only maxima
    and counts come out. Other columns of ``docs`` are left out, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates).collect()  # the fixed table above
    every = F.array(*[F.lit(h) for h in sorted({h for t in known for h in t["shingles"]})]).cast("array<bigint>")
    rows = with_shingles(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text").filter(F.arrays_overlap("hashes", every))
    own = {c: sorted({h for t in known if t["class"] == c for h in t["shingles"]}) for c in sorted({t["class"] for t in known})}
    of_class = F.create_map(*[x for c, hs in own.items() for x in (F.lit(c), F.array(*[F.lit(h) for h in hs]))])
    classes = F.explode(F.array(*[F.lit(c) for c in own]))
    cut = rows.select("_id", "hashes", classes.alias("class"))
    windows = cut.select(
        "_id", "class",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("hashes"), F.lit(1)), F.col("class")), lambda i: F.array_distinct(F.slice("hashes", i, F.col("class") * 2)))).alias("window"),
    )
    # A window without any shingle of its class has similarity 0 to all templates of it: no band can match.
    windows = windows.filter(F.arrays_overlap("window", F.element_at(of_class, F.col("class"))))
    banded = windows.select("_id", "class", "window", F.posexplode(_bands(F.col("window"), bands)).alias("band", "low"))
    table = template_table(spark, templates)
    keys = table.select("license", "template", "class", "shingles", F.posexplode(_bands(F.col("shingles"), bands)).alias("band", "low"))
    met = banded.join(F.broadcast(keys), ["class", "band", "low"])  # a few thousand rows, whatever the input
    matched = F.array_sort(F.array_intersect("window", "shingles"))
    held = met.select("_id", "license", "template", "window", matched.alias("matched"), F.size("shingles").alias("n")).filter(F.size("matched") >= F.col("n") * containment)
    held = held.groupBy("_id", F.xxhash64("window").alias("w")).agg(F.collect_set(F.struct("license", "template", "matched", (F.size("matched") / F.col("n")).alias("containment"))).alias("all"))  # a window holds some templates at most
    # Templates that differ in a word or two meet in one window: what a better one explains in full goes.
    better = lambda t: F.exists("all", lambda o: (o["containment"] > t["containment"]) & (F.size(F.array_except(t["matched"], o["matched"])) == 0))
    places = held.select("_id", "w", F.explode(F.filter("all", lambda t: ~better(t))).alias("t"))
    return places.groupBy(F.col("_id").alias(id_col), F.col("t.license").alias("license")).agg(F.max("t.containment").alias("containment"), F.countDistinct("w").alias("places"))
