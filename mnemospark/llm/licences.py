"""Licence scans (operator 10). DataFrame operations only.

A notice (lines round one that speaks of a licence) is compared with templates by the cosine of sparse TF-IDF vectors.
A term's document frequency is counted over all documents and joined to the terms of notices; only those of the
templates' terms reach the driver. The mode of `oracle` scores single lines, and licence files as a whole, and weighs a
term that no template has as one that every document has. A file without a licence of its own has that of its nearest ancestor directory with a
licence file: directories are joined with their ancestors' licences first, files with their directory last.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.shared import materialize, spread_join

#: Usual notices of common licences, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal Public Domain Dedication"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose"),
)
#: Identifiers that files name after SPDX-License-Identifier, and the licence of each.
IDENTIFIERS = (
    ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("BSL-1.0", "BSL-1.0"), ("Unlicense", "Unlicense"), ("Zlib", "Zlib"),
    ("GPL-2.0", "GPL-2.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"),
    ("LGPL-2.1", "LGPL-2.1"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0"), ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"),
    ("AGPL-3.0", "AGPL-3.0"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("CC0-1.0", "CC0-1.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
)
NOTICES = TEMPLATES + tuple((licence, f"SPDX-License-Identifier: {name}") for licence, name in IDENTIFIERS)
#: An identifier after that mark counts as one more term, so often that two different ones are never alike.
TAG, TAG_WEIGHT = "spdx-license-identifier:[ \\t]*([a-z0-9.+-]+)", 4
_AS_IS = "AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Whole texts of short licences; a licence file by name is compared with them as a whole.
WHOLE = (
    ("BSD-2-Clause", f"{_BSD} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS {_AS_IS}"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"),
    ("Zlib", "zlib License This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
#: A line with one of these is a notice; so is the whole of a licence file.
CUE = "licen[cs]|copyright|spdx|redistribut|permission is hereby|permission to use|free software|unencumbered software|provided .as-is"
#: A text without any of these holds no cue; they are far cheaper to look for.
HINTS = ("licen", "copyright", "spdx", "redistribut", "permission", "software", "provided")
LICENCE_FILE = r"(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
#: Titles that the full texts of licences begin with; only licence files by name are compared with them.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
EVERY = NOTICES + TITLES + WHOLE
LEAST_COSINE, LEAST_COVER = 0.7, 0.5
#: Lines of a window round a cue; the longest template, wrapped to four words a line, has seven.
MOST_LINES = 8


def lowered(text: Column) -> Column:
    return F.lower(text)


def terms(text: Column) -> Column:
    low = lowered(text)
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda t: t != "")
    tags = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(TAG), F.lit(1)), lambda t: F.array_repeat(F.concat(F.lit("spdx:"), t), TAG_WEIGHT)))
    return F.when(F.contains(low, F.lit("spdx-license-identifier")), F.concat(words, tags)).otherwise(words)


def words_of(text: str) -> list[str]:
    low = text.lower()
    return re.findall("[a-z0-9]+", low) + [f"spdx:{t}" for t in re.findall(TAG, low) for _ in range(TAG_WEIGHT)]


def template_terms(templates: tuple = NOTICES) -> list[Counter]:
    return [Counter(words_of(text)) for _, text in templates]


def idf(docs: DataFrame) -> dict[str, float]:
    """ln((N + 1) / (df + 1)) + 1 of each template term, N and df over all ``docs`` (null texts are empty ones)."""
    vocabulary = sorted({t for c in template_terms() for t in c})
    own = F.array_intersect(terms(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    # the empty term counts the documents
    rows = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    df = {r.term: r.df for r in rows}
    return {t: math.log((df.get("", 0) + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}


def weights(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])


def adding(product: Column):
    return lambda acc, t: acc + F.coalesce(F.element_at(product, t), F.lit(0.0))


def best_template(words: Column, weight: dict[str, float]) -> Column:
    """(cosine, licence) of the best template for an array of terms; of equals the first licence by name."""
    idf_of = weights(weight)
    value = lambda t: F.coalesce(F.element_at(idf_of, t), F.lit(1.0))
    # equal terms stand together, and the k-th of a run adds (k^2 - (k - 1)^2) idf^2
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(acc["last"] == t, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), (acc["sum"] + (2 * run - 1) * value(t) * value(t)).alias("sum"))

    norm = F.sqrt(F.aggregate(F.array_sort(words), zero, step, lambda acc: acc["sum"]))
    scored = []
    for (licence, _), counts in zip(NOTICES, template_terms()):
        length = math.sqrt(sum((n * weight[t]) ** 2 for t, n in counts.items()))
        product = weights({t: n * weight[t] ** 2 / length for t, n in counts.items()})
        dot = F.aggregate(words, F.lit(0.0), adding(product))
        scored.append(F.struct((-F.round(dot / norm, 6)).alias("minus"), F.lit(licence).alias("licence")))
    best = F.array_min(F.array(*scored))
    return F.struct((-best["minus"]).alias("cosine"), best["licence"].alias("licence"))


def scan(files: DataFrame, weight: dict[str, float], keep: list[str]) -> DataFrame:
    """Each file's own licence: ``keep``, path, dir, licence, cosine, is_file (whether it speaks for its directory).

    Files have ``path`` and ``text``. The licence is that of the best notice of cosine ``LEAST_COSINE`` or more. A
    licence file is one by name, or one of whose terms half or more lie in such notices. Rows stay as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    by_name = F.coalesce(lowered(F.col("path")).rlike(LICENCE_FILE), F.lit(False))
    lines = F.when(by_name, F.array(text)).otherwise(F.filter(F.split(text, "\n"), lambda s: lowered(s).rlike(CUE)))
    speaks = by_name | lowered(text).rlike(CUE)
    scored = F.transform(F.filter(F.transform(lines, terms), lambda w: F.size(w) > 0), lambda w: F.struct(best_template(w, weight).alias("best"), F.size(w).alias("n")))
    scored = F.filter(scored, lambda s: s["best"]["cosine"] >= LEAST_COSINE)
    found = files.withColumn("_found", F.when(speaks, scored))
    top = F.array_min(F.transform("_found", lambda s: F.struct((-s["best"]["cosine"]).alias("minus"), s["best"]["licence"].alias("licence"))))
    covered = F.aggregate("_found", F.lit(0), lambda acc, s: acc + s["n"])
    cover = F.when(F.size("_found") > 0, covered / F.size(terms(text)))
    return found.select(
        *keep,
        "path",
        F.regexp_replace("path", "/?[^/]*$", "").alias("dir"),
        top["licence"].alias("licence"),
        (-top["minus"]).alias("cosine"),
        ((F.size("_found") > 0) & (by_name | (cover >= LEAST_COVER))).alias("is_file"),
    )


def file_by_name() -> Column:
    return F.coalesce(lowered(F.col("path")).rlike(LICENCE_FILE), F.lit(False))


def surroundings(texts: DataFrame) -> DataFrame:
    """A row for each cue line ``at`` of ``texts`` (_key, _by_name, _text): the terms of the lines round it, from line ``first``.

    In a licence file each line is a cue. A cue may run over a line's end.
    """
    cue = CUE.replace(" ", "[^a-z0-9]+")
    split = texts.select("_key", "_by_name", F.split(lowered(F.col("_text")), "\n").alias("lines"))
    split = split.select("*", F.transform("lines", terms).alias("words"), F.size(terms(F.array_join("lines", "\n"))).alias("total"))
    following = lambda i: F.coalesce(F.get("lines", i + 1), F.lit(""))
    wrapped = lambda i: F.concat_ws("\n", F.get("lines", i), following(i)).rlike(cue) & ~following(i).rlike(cue)
    cues = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.col("_by_name") | F.get("lines", i).rlike(cue) | wrapped(i))
    first = lambda i: F.greatest(F.lit(0), i - (MOST_LINES - 1))
    around = F.transform(cues, lambda i: F.struct(i.alias("at"), first(i).alias("first"), F.slice("words", first(i) + 1, i + MOST_LINES - first(i)).alias("near")))
    return split.select("_key", "_by_name", "total", F.inline(around))


def frequencies(files: DataFrame) -> DataFrame:
    """(term, df) of every term of all ``files``."""
    return files.select(F.explode(F.array_distinct(terms(F.coalesce(F.col("text"), F.lit(""))))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def rarity(df: Column, n: int) -> Column:
    return F.log(F.lit(float(n + 1)) / (df + 1)) + 1


def template_weights(weight: dict[str, float]) -> dict[str, list[float]]:
    """What one occurrence of a term adds to the product with each template of length 1."""
    table: dict[str, list[float]] = {}
    for k, counts in enumerate(template_terms(EVERY)):
        length = math.sqrt(sum((n * weight[t]) ** 2 for t, n in counts.items()))
        for t, n in counts.items():
            table.setdefault(t, [0.0] * len(EVERY))[k] = n * weight[t] ** 2 / length
    return table


def line_products(near: DataFrame, df: DataFrame, n: int, weight: dict[str, float]) -> DataFrame:
    """``near`` with its terms as numbers, their idf, and each line's products with all templates, written once.

    A term meets its document frequency and its template weights once a row; products of windows are sums of those of their lines.
    """
    row = ["_key", "_by_name", "at"]
    table = near.sparkSession.createDataFrame(list(template_weights(weight).items()), "term string, w array<double>")
    each = near.select(*row, F.explode(F.array_distinct(F.flatten("near"))).alias("term")).join(df, "term").join(F.broadcast(table), "term", "left")
    lists = each.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("term", rarity(F.col("df"), n).alias("idf"), "w"))).alias("terms"))
    rows = near.join(lists, row).withColumn("codes", F.transform("near", lambda line: F.transform(line, lambda t: (F.array_position(F.col("terms.term"), t) - 1).cast("int"))))
    zero = F.array_repeat(F.lit(0.0), len(EVERY))

    def add(acc: Column, c: Column) -> Column:
        w = F.get(F.col("terms.w"), c)
        return F.when(w.isNull(), acc).otherwise(F.zip_with(acc, w, lambda a, b: a + b))

    products = F.transform("codes", lambda line: F.aggregate(line, zero, add))
    return materialize(rows.select(*row, "first", "total", "codes", F.col("terms.idf").alias("idf"), products.alias("products")), "lines")


def best_window() -> Column:
    """(minus the cosine, lines, a, b, licence) of the best window of lines a to b that holds the cue; the shortest of equals."""
    here = F.col("at") - F.col("first")
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        # equal terms stand together, and the k-th of a run adds (k^2 - (k - 1)^2) idf^2
        run = F.when(acc["last"] == c, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(c.alias("last"), run.alias("run"), (acc["sum"] + (2 * run - 1) * F.pow(F.get("idf", c), F.lit(2))).alias("sum"))

    def window(a: Column, b: Column) -> Column:
        words = F.flatten(F.slice("codes", a + 1, b - a + 1))
        rest = F.slice("products", a + 2, b - a)
        dots = F.aggregate(rest, F.get("products", a), lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))
        return F.struct(a.alias("a"), b.alias("b"), F.size(words).alias("n"), F.sqrt(F.aggregate(F.array_sort(words), zero, step, lambda acc: acc["sum"])).alias("norm"), dots.alias("dots"))

    ends = F.sequence(here, F.size("codes") - 1)
    windows = F.flatten(F.transform(F.sequence(F.lit(0), here), lambda a: F.transform(F.filter(ends, lambda b: b - a < MOST_LINES), lambda b: window(a, b))))
    names = F.array(*[F.lit(licence) for licence, _ in EVERY])
    # notices for every window, titles for those of licence files, whole texts for whole files
    low = F.when(F.col("at") < 0, len(NOTICES + TITLES)).otherwise(0)
    high = F.when(F.col("at") < 0, len(EVERY)).when(F.col("_by_name"), len(NOTICES + TITLES)).otherwise(len(NOTICES))

    def scored(w: Column) -> Column:
        one = lambda d, k: F.when((k >= low) & (k < high), F.struct((-F.round(d / w["norm"], 6)).alias("minus"), (w["b"] - w["a"]).alias("lines"), w["a"].alias("a"), w["b"].alias("b"), F.get(names, k).alias("licence")))
        return F.array_min(F.transform(w["dots"], one))

    return F.array_min(F.transform(F.filter(windows, lambda w: w["n"] > 0), scored))


def scan_windows(files: DataFrame, keep: list[str]) -> DataFrame:
    """As `scan`, but a notice is the best window of consecutive lines round a cue, in licence files by name too.

    Every term of a notice has its idf over all ``files``. Each text is scored once; its copies spread over tasks when the result is joined back.
    """
    text, by_name = F.coalesce(F.col("text"), F.lit("")), file_by_name()
    low = lowered(text)
    hinted = functools.reduce(Column.__or__, [F.contains(low, F.lit(h)) for h in HINTS])
    speaks = by_name | (hinted & low.rlike(CUE.replace(" ", "[^a-z0-9]+")))
    rows = materialize(files.select(*keep, "path", by_name.alias("_by_name"), F.when(speaks, text).alias("_text")), "notices")
    texts = rows.where("_text is not null").groupBy(F.sha2("_text", 256).alias("_key"), "_by_name").agg(F.first("_text").alias("_text"))
    n, df = rows.count(), materialize(frequencies(files), "frequencies")
    vocabulary = sorted({t for c in template_terms(EVERY) for t in c})
    known = {r.term: r.df for r in df.where(F.col("term").isin(vocabulary)).collect()}
    weight = {t: math.log((n + 1) / (known.get(t, 0) + 1)) + 1 for t in vocabulary}
    body = terms(F.col("_text"))
    whole = texts.where("_by_name").select("_key", "_by_name", F.size(body).alias("total"), F.lit(-1).alias("at"), F.lit(-1).alias("first"), F.array(body).alias("near"))
    lines = line_products(surroundings(texts).unionByName(whole), df, n, weight)
    found = lines.withColumn("best", best_window()).where(F.col("best.minus") <= -LEAST_COSINE)
    covered = F.transform(F.sequence("best.a", "best.b"), lambda k: F.struct((F.col("first") + k).alias("line"), F.size(F.get("codes", k)).alias("n")))
    found = found.groupBy("_key", "_by_name").agg(F.min(F.struct((F.col("at") >= 0).alias("part"), "best.minus", "best.licence")).alias("top"), F.array_distinct(F.flatten(F.collect_list(covered))).alias("lines"), F.first("total").alias("total"))
    cover = F.aggregate("lines", F.lit(0), lambda acc, x: acc + x["n"]) / F.col("total")
    found = found.select(F.struct("_key", "_by_name").alias("_text_id"), "top", (F.col("_by_name") | (cover >= LEAST_COVER)).alias("is_file"))
    # files that say nothing have no key
    own = F.when(F.col("_text").isNotNull(), F.struct(F.sha2("_text", 256).alias("_key"), F.col("_by_name")))
    return spread_join(rows.withColumn("_text_id", own).drop("_text"), found, "_text_id", ["path", *keep]).select(
        *keep,
        "path",
        F.regexp_replace("path", "/?[^/]*$", "").alias("dir"),
        F.col("top.licence").alias("licence"),
        (-F.col("top.minus")).alias("cosine"),
        F.coalesce("is_file", F.lit(False)).alias("is_file"),
    )


def inherited(scanned: DataFrame) -> DataFrame:
    """``scanned`` with origin ('own', 'inherited' or 'none') and from_dir; the rest take the nearest ancestor's licence.

    Of several licence files in a directory the best cosine counts, then the licence's name. The top directory is ''.
    Files of a crowded directory spread over salts.
    """
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), F.col("licence").alias("licence")))
    speaking = scanned.where("is_file").groupBy("dir").agg(best.alias("best")).select(F.col("dir").alias("up"), F.col("best.licence").alias("up_licence"))
    parts = F.split("dir", "/")
    ancestors = F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("up"))), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up"))))
    dirs = scanned.where("dir is not null").select("dir").distinct().select("dir", F.inline(F.when(F.col("dir") == "", F.slice(ancestors, F.lit(1), F.lit(1))).otherwise(ancestors)))
    nearest = dirs.join(speaking, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "up_licence")).alias("near"))
    nearest = nearest.select("dir", F.col("near.up").alias("up"), F.col("near.up_licence").alias("up_licence"))
    rows = spread_join(scanned, nearest, "dir", ["path"])
    own = F.col("licence").isNotNull()
    return rows.select(
        *[c for c in scanned.columns if c not in ("licence", "cosine", "is_file", "dir")],
        F.coalesce("licence", "up_licence").alias("licence"),
        "cosine",
        F.when(own, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("up")).alias("from_dir"),
    )


def licences(files: DataFrame, keep: list[str], windows: bool = False) -> DataFrame:
    """Scan ``files`` (path, text and the ``keep`` columns) and let directories pass their licences down.

    Null and empty texts have no licence of their own; a null path has no directory. With ``windows`` notices may be
    wrapped and lie in longer licence files, and all terms have their idf; without, they are as in `oracle`.
    """
    return inherited(materialize(scan_windows(files, keep) if windows else scan(files, idf(files), keep), "licences"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/number/doc_id.txt, a hundred ids in a directory; nulls are '_'."""
    part = lambda c: F.coalesce(F.col(c), F.lit("_"))
    number = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("_"))
    path = F.concat_ws("/", part("source"), part("lang"), number, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("_")), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def oracle() -> str:
    """The same rows in DuckDB."""
    templates = ", ".join("(%d, '%s', '%s')" % (k, licence, text.replace("'", "''")) for k, (licence, text) in enumerate(NOTICES))
    low = lambda x: f"lower({x})"
    tags = lambda x: f"flatten(list_transform(regexp_extract_all({low(x)}, '{TAG}', 1), lambda g: list_transform(range({TAG_WEIGHT}), lambda i: 'spdx:' || g)))"
    words = lambda x: f"list_concat(regexp_extract_all({low(x)}, '[a-z0-9]+'), {tags(x)})"
    cue = lambda x: f"regexp_matches(lower({x}), '{CUE}')"
    return f"""
    with d as (select row_number() over () rid, doc_id, coalesce(text, '') t,
        coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(cast(cast(floor(doc_id / 100) as bigint) as varchar), '_') dir from documents),
    tt as (select k, licence, unnest({words('x')}) w from (values {templates}) v(k, licence, x)),
    voc as (select distinct w from tt),
    df as (select w, count(distinct rid) df from (select rid, unnest({words('t')}) w from d) where w in (select w from voc) group by w),
    idf as (select voc.w, ln(((select count(*) from d) + 1) / cast(coalesce(df, 0) + 1 as double)) + 1 x from voc left join df on voc.w = df.w),
    tv as (select k, any_value(licence) licence, w, count(*) n from tt group by k, w),
    tn as (select k, sqrt(sum(n * n * x * x)) nrm from tv join idf using (w) group by k),
    l as (select rid, s, row_number() over () lid from (select rid, unnest(string_split(t, chr(10))) s from d where {cue('t')}) where {cue('s')}),
    lw as (select lid, w, count(*) n from (select lid, unnest({words('s')}) w from l) group by lid, w),
    ln as (select lid, sqrt(sum(n * n * coalesce(x, 1) * coalesce(x, 1))) nrm, sum(n) n from lw left join idf using (w) group by lid),
    dot as (select lid, k, sum(lw.n * tv.n * x * x) dot from lw join tv using (w) join idf using (w) group by lid, k),
    cs as (select lid, licence, max(round(dot / (ln.nrm * tn.nrm), 6)) c from dot join ln using (lid) join tn using (k) join (select distinct k, licence from tv) using (k) group by lid, licence),
    bl as (select lid, max(c) c, arg_min(licence, struct_pack(m := -c, l := licence)) licence from cs group by lid having max(c) >= {LEAST_COSINE}),
    own as (select rid, max(c) c, arg_min(licence, struct_pack(m := -c, l := licence)) licence, sum(n) n from bl join l using (lid) join ln using (lid) group by rid),
    f as (select d.*, own.licence, own.c, coalesce(own.n / cast(len({words('t')}) as double) >= {LEAST_COVER}, false) is_file from d left join own on d.rid = own.rid),
    sp as (select dir, arg_min(licence, struct_pack(m := -c, l := licence)) licence from f where is_file group by dir)
    select doc_id, f.dir || '/' || coalesce(cast(doc_id as varchar), '_') || '.txt' path, coalesce(f.licence, sp.licence) licence, c cosine,
        case when f.licence is not null then 'own' when sp.dir is not null then 'inherited' else 'none' end origin,
        case when f.licence is null then sp.dir end from_dir from f left join sp on f.dir = sp.dir
    """
