"""Licence scans: passages compared to licence templates by Dice coefficient.

A passage is a line of a document, or its whole text if that has several lines.
Passages and templates are lower-cased and cut to runs of letters and digits;
the Dice coefficient is taken over distinct word bigrams.  A coefficient of t
needs sizes within t/(2-t) of each other, so a template meets only passages of
the sizes it can match: an equality join on the size, after sizes that fit no
template are gone.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.decontaminate import bound, words_of

# Published licence statements, notices and paragraphs.
TEMPLATES = [
    ("AGPL-3.0", "statement", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "statement", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "statement", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "statement", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("CC-BY-4.0", "statement", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "statement", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "statement", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "statement", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "statement", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "statement", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "statement", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "statement", "Released under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "statement", "All rights reserved."),
]
#: Templates that may be joined by broadcast.
BROADCAST_TEMPLATES = 10_000


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(templates, "licence string, part string, template string")


def bigrams(words: Column) -> Column:
    """Hashes of the distinct adjacent word pairs."""
    def use(w):
        at = F.sequence(F.lit(0), F.size(w) - 2)
        return F.when(F.size(w) > 1, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))
                      ).otherwise(F.array().cast("array<bigint>"))
    return bound(words, use)


def licence_scan(docs: DataFrame, templates: DataFrame, ident: str = "doc_id", text: str = "text",
                 threshold: float = 0.8) -> DataFrame:
    """(ident, line, licence, part, dice): the best template of every passage that reaches ``threshold``.

    ``line`` counts lines from 0; -1 is the whole text of several lines.  Ties go
    to the smaller licence and part.  Passages and templates of one word have no
    bigram and match nothing; null texts are empty.  Rows that repeat an ident
    and line give the better one.
    """
    t = templates.select("licence", "part", bigrams(words_of(F.col("template"))).alias("tb")).withColumn("m", F.size("tb")).filter("m > 0")
    n_templates, most = t.agg(F.count(F.lit(1)), F.max("m")).first()
    if not n_templates:
        most = 0
    ratio = threshold / (2 - threshold)
    top = int(most / ratio + 1e-9)
    low, high = F.ceil(F.col("m") * ratio - 1e-9).cast("int"), F.floor(F.col("m") / ratio + 1e-9).cast("int")
    sized = t.withColumn("n", F.explode(F.sequence(low, high)))
    fits = sized.select("n").distinct()

    # sizes are tested inside the row, so only passages that some template fits are exploded
    def passage(line, s):
        return F.struct(line.alias("line"), bigrams(words_of(s)).alias("b"))

    def passages(lines):
        whole = F.transform(F.filter(F.array(F.col(text)), lambda s: F.size(lines) > 1), lambda s: passage(F.lit(-1), s))
        return F.filter(F.concat(F.transform(lines, lambda s, i: passage(i, s)), whole),
                        lambda x: (F.size(x["b"]) > 0) & (F.size(x["b"]) <= top))

    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    # the outer form, since the optimizer guards the other one by evaluating the array twice more
    p = (docs.select(F.col(ident).alias("doc"), F.explode_outer(bound(lines, passages)).alias("p")).filter("p is not null")
         .select("doc", "p.line", "p.b", F.size("p.b").alias("n")))
    hint = F.broadcast if (n_templates or 0) <= BROADCAST_TEMPLATES else (lambda df: df)
    p = p.join(hint(fits), "n", "left_semi")
    pairs = p.join(hint(sized), "n")
    both = F.size(F.array_intersect("b", "tb"))
    scored = pairs.withColumn("dice", F.lit(2.0) * both / (F.col("n") + F.col("m"))).filter(F.col("dice") >= threshold - 1e-12)
    best = scored.groupBy("doc", "line").agg(F.min(F.struct((-F.col("dice")).alias("d"), "licence", "part")).alias("x"))
    return best.select(F.col("doc").alias(ident), "line", "x.licence", "x.part", F.round(-F.col("x.d"), 6).alias("dice"))
