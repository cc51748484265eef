"""License scans: TF-IDF cosine of header lines to templates, then inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import free_name, without_results

#: SPDX identifiers, and what declares them (sentences, titles, notices, whole texts).
TEMPLATES = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "BSD-2-Clause": (
        "BSD 2-Clause License",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license.",
        "BSD 3-Clause License",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    "ISC": (
        "ISC License",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MIT": (
        "Released under the MIT License.",
        "MIT License",
        "The MIT License (MIT)",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1.", "Mozilla Public License Version 1.1"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "Zlib": ("Released under the zlib License.", "zlib License"),
}
#: Terms that tell neighbours apart, by what a template holds; it and a unit must have the same of them.
APART = {
    ("gnu", "gpl", "lgpl", "agpl"): ("gpl", "lgpl", "agpl", "lesser", "affero"),
    ("creative", "cc"): ("sharealike", "noncommercial", "noderivatives", "noderivs", "sa", "nc", "nd"),
    ("redistributions",): ("endorse",),
}
#: Names, which a unit must hold where a template does.
NAMES = ("apache", "bsd", "cc", "creative", "gnu", "isc", "mit", "mozilla", "mpl", "unencumbered", "unlicense", "zlib")


def templates() -> list[tuple[str, str]]:
    """(identifier, text) of TEMPLATES, and each identifier's tag, for the GNU ones with their two endings too."""
    out = [(k, x) for k, texts in TEMPLATES.items() for x in texts]
    return out + [(k, f"SPDX-License-Identifier: {k}{e}") for k in TEMPLATES for e in ("", *(("-only", "-or-later") if "GPL" in k else ()))]


def vetoes(text: str) -> tuple[list[str], list[str]]:
    """(needed, barred): terms that a unit must hold, and must not, to be taken for a template.

    Needed are its names, its digits (versions and numbers of clauses; but for those of a list
    of conditions, which may have other signs), and of the terms in APART those it has;
    barred are the others of these.  A version that isn't the template's, where one is needed, is
    another license, however alike the rest is.
    """
    have = set(terms(text))
    apart = {t for heads, group in APART.items() if have & set(heads) for t in group}
    digits = set() if "redistributions" in have else {t for t in have if len(t) == 1 and t.isdigit()}
    return sorted((apart & have) | digits | (have & set(NAMES))), sorted(apart - have)


#: A header line holds one of these.
ANCHOR = "licen[sc]e|spdx"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SALTS = 16


def terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))


#: What parts paragraphs: lines without a letter a-z or a digit.
PARTED = "\n[^a-z0-9]*\n"


def _terms(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))


def _anchored(parts: Column) -> Column:
    return F.filter(parts, lambda x: x.rlike(ANCHOR))


def _headers(text: Column) -> Column:
    """The terms of each header line."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "\n")
    return F.transform(_anchored(lines), _terms)


def _units(text: Column, whole: Column) -> Column:
    """The terms of each header line, of it with the line before and with the line after, of each paragraph that holds one, and, where ``whole``, of the text."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)

    def around(lines):
        side = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
        every = F.transform(lines, lambda x, i: F.when(x.rlike(ANCHOR), F.array(x, F.concat_ws(" ", x, side(i + 1)), F.concat_ws(" ", side(i - 1), x))))
        return F.flatten(F.array_compact(every))

    near = F.flatten(F.transform(F.array(F.split(low, "\n")), around))
    blocks = _anchored(F.split(low, PARTED))
    return F.transform(F.concat(near, blocks, F.when(whole, F.array(low)).otherwise(F.array().cast("array<string>"))), _terms)


def known_terms() -> list[str]:
    """The terms of all templates, and those that tell them apart."""
    return sorted({t for _, x in templates() for t in terms(x)} | {t for group in APART.values() for t in group})


def _idf(files: DataFrame, text_col: str) -> tuple[dict[str, float], float]:
    """ln((1 + n) / (1 + df)) + 1 over all header lines, of the templates' terms; and that of a term never seen.

    What comes to the driver is one row for each term of the templates.
    """
    known = known_terms()
    lines = files.filter(F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER).rlike(ANCHOR)).select(F.explode(_headers(F.col(f"`{text_col}`"))).alias("t"))
    # One marker per line counts the lines themselves.
    marked = lines.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(F.array_distinct("t"), F.array(*map(F.lit, known))))).alias("term"))
    df = {r["term"]: r["n"] for r in marked.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = df.get("", 0)
    return {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in known}, math.log(1 + n) + 1


def _plus(weights: Column):
    return lambda s, x: s + x["v"] * F.coalesce(F.try_element_at(weights, x["t"]), F.lit(0.0))


def _match(line: Column, idf: dict[str, float], unseen: float) -> Column:
    """struct(score, license) of the template nearest to a unit's terms; linear in their number."""
    weight = F.create_map(*[F.lit(x) for t, v in idf.items() for x in (t, v)])

    def counted(ordered):
        # Where each distinct term begins among the sorted ones: its number is the way to the next.
        begins = F.array_compact(F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i)))

        def weighed(t, n, w):
            return F.struct(F.when(w.isNotNull(), t).alias("t"), (n * F.coalesce(w, F.lit(unseen))).alias("v"))

        def entries(at):
            return F.transform(at, lambda p, k: weighed(F.get(ordered, p), F.coalesce(F.get(at, k + 1), F.size(ordered)) - p, F.try_element_at(weight, F.get(ordered, p))))

        return F.element_at(F.transform(F.array(begins), entries), 1)

    def nearest(both):
        vector = both["known"]  # terms of no template have a part in the length alone
        norm, held = both["norm"], both["terms"]
        scores = []
        for name, text in templates():
            tf = Counter(terms(text))
            length = math.sqrt(sum((k * idf[t]) ** 2 for t, k in sorted(tf.items())))
            own = F.create_map(*[F.lit(x) for t, k in tf.items() for x in (t, k * idf[t])])
            dot = F.aggregate(vector, F.lit(0.0), _plus(own))
            needed, barred = (F.array(*map(F.lit, x)).cast("array<string>") for x in vetoes(text))
            fits = (F.size(F.array_except(needed, held)) == 0) & ~F.arrays_overlap(barred, held) & (norm > 0)
            scores.append(F.struct(F.round(F.when(fits, dot / (norm * length)).otherwise(0.0), 6).alias("score"), F.lit(name).alias("license")))
        return F.array_max(F.array(*scores))

    def measured(vector):
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x["v"] * x["v"]))
        known = F.filter(vector, lambda x: x["t"].isNotNull())
        return F.struct(known.alias("known"), F.transform(known, lambda x: x["t"]).alias("terms"), norm.alias("norm"))

    vectors = F.transform(F.transform(F.array(F.sort_array(line)), counted), measured)
    return F.element_at(F.transform(vectors, nearest), 1)


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", license_file: Column | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per file: files' columns, then license, score, origin, license_dir.

    Header lines are the lines of the whole text that hold ANCHOR, A-Z lower-cased.  What is
    compared with the templates is each header line, alone, with the line before and with the
    line after it (for wrapped sentences), each paragraph that holds a header line (for
    notices of several lines), and the whole text of a license file.  Terms are runs of
    ``[a-z0-9]``, so comment signs don't count.  A file's own license is that of the template
    with the highest TF-IDF cosine to any of these, if it is ``threshold`` or more (scores
    are rounded to six places; ties go to the later identifier); a template whose version or
    other telling terms differ (``vetoes``) doesn't count, however alike the rest is.  Document frequencies are
    counted over all header lines of all files; a term outside the templates weighs like one
    never seen.  ``license_file`` tells the files that speak for their directory (by default
    those named LICENSE, LICENCE, COPYING or NOTICE, with any ending); of several in one
    directory, the highest score decides, then the later identifier.  A file without a
    license of its own inherits that of the nearest ancestor directory that has one:
    license_dir names it.  origin is "own", "inherited" or "none".  A null text has no
    header lines; a null path lies in no directory; repeated rows are scanned alike; an
    empty table gives an empty result; columns of files that bear a result's name, in any
    case, are replaced.  Very long lines and texts are scored in time linear in their terms.

    DataFrame functions only.  Scores are narrow expressions; each directory is joined to
    its ancestors once, and files meet their directory under one of several salts, so that a
    directory of very many files is dealt to several tasks.
    """
    files = without_results(files, ("license", "score", "origin", "license_dir"), path_col, text_col)
    best, dir_, salt, mine, j_dir, j_salt, found = free_name(files, "best", "dir", "salt", "speaks", "join_dir", "join_salt", "inherited")
    text, path = F.col(f"`{text_col}`"), F.col(f"`{path_col}`")
    if license_file is None:
        license_file = F.regexp_extract(path, "[^/]*$", 0).rlike("^(?i:LICEN[SC]E|COPYING|NOTICE)")
    idf, unseen = _idf(files, text_col)
    none = F.lit(None).cast("struct<score:double,license:string>")
    rows = files.withColumn(mine, F.coalesce(license_file, F.lit(False)))
    scored = F.array_max(F.transform(_units(text, F.col(mine)), lambda x: _match(x, idf, unseen)))
    rows = rows.withColumn(best, F.when(F.col(mine) | F.translate(text, _UPPER, _LOWER).rlike(ANCHOR), scored).otherwise(none))
    rows = rows.withColumn(best, F.when(F.col(best)["score"] >= threshold, F.col(best)))
    rows = rows.withColumn(dir_, F.regexp_replace(path, "/?[^/]*$", ""))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(path, text), F.lit(_SALTS)))
    dirs = rows.filter(F.col(dir_).isNotNull()).groupBy(F.col(dir_).alias("d")).agg(F.max(F.when(F.col(mine), F.col(best))).alias("says"))
    # Ancestors of a/b/c: itself, a/b, a and the root (the empty path).
    steps = F.split("d", "/")
    depth = F.when(F.col("d") == "", 0).otherwise(F.size(steps))
    up = dirs.select("d", F.explode(F.sequence(F.lit(0), depth)).alias("depth"), steps.alias("steps")).select("d", "depth", F.array_join(F.slice("steps", 1, F.col("depth")), "/").alias("up"))
    spoken = dirs.filter("says is not null").select(F.col("d").alias("up"), "says")
    nearest = up.join(spoken, "up").groupBy("d").agg(F.max(F.struct("depth", "says", "up")).alias("near"))
    near = nearest.select(F.col("d").alias(j_dir), F.struct(F.col("near.says.score").alias("score"), F.col("near.says.license").alias("license"), F.col("near.up").alias("up")).alias(found), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias(j_salt))
    out = rows.join(near, (F.col(dir_) == F.col(j_dir)) & (F.col(salt) == F.col(j_salt)), "left")
    own = F.col(best).isNotNull()
    pick = lambda x: F.when(own, F.col(best)[x]).otherwise(F.col(found)[x])
    return out.select(
        *[F.col(f"`{c}`") for c in files.columns],
        pick("license").alias("license"),
        pick("score").alias("score"),
        F.when(own, "own").when(F.col(found).isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col(found)["up"]).alias("license_dir"),
    )
