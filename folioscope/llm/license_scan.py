"""License scans: sentences of a document compared to licence notices by Dice over word bigrams.

A document's units are its sentences.  A unit and a template are sets of bigrams of normalised
words; they match if 2 |A and B| / (|A| + |B|) reaches `THRESHOLD`.  The size bound
t / (2 - t) <= |A| / |B| <= (2 - t) / t leaves few templates for a unit.  A match also needs one of
its template's necessary bigrams (one more than may be missing); a document with none of their
telling words is passed over.

What the matching sentences leave is read again as one run of words, in which line breaks and
sentence ends don't count: windows of as many words as a notice has are compared with it in the
same way, so wrapped notices and those inside longer sentences and licence texts are found.  Long
notices and whole licence bodies must hold a bigram with a telling word (`TELLING`), and their
windows are those that the place of such a bigram in the notice gives.  Of overlapping windows the one that shares the most bigrams counts.  All of it is one
row expression: no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = Fraction(4, 5)

#: (licence, kind, notice): fixed values, the public notices of these licences.
TEMPLATES = [
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "permissive", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "noncommercial", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "noncommercial", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "noderivatives", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "noderivatives", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "permissive", "This is free and unencumbered software released into the public domain."),
]

_GNU = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Notices that only windows are compared with, besides `TEMPLATES`: the usual headers of the GNU licences.
NOTICES = [
    ("GPL-2.0", "copyleft", _GNU.format("This program", "", "2")),
    ("GPL-3.0", "copyleft", _GNU.format("This program", "", "3")),
    ("LGPL-2.1", "copyleft", _GNU.format("This library", "Lesser ", "2.1")),
    ("LGPL-3.0", "copyleft", _GNU.format("This library", "Lesser ", "3")),
    ("AGPL-3.0", "copyleft", _GNU.format("This program", "Affero ", "3")),
]

_WARRANTY_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NO_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
#: Whole licence bodies, which windows are compared with too: fixed values, the public texts of these licences.
BODIES = [
    ("MIT", "permissive", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "permissive", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", "permissive", _BSD + _WARRANTY_BSD),
    ("BSD-3-Clause", "permissive", _BSD + _NO_ENDORSEMENT + _WARRANTY_BSD),
    ("Zlib", "permissive", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "permissive", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Apache-2.0", "permissive", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Words that are rare but in notices: a notice's necessary bigrams are chosen among theirs first.
TELLING = "unencumbered affero mozilla noncommercial redistribution redistribute licensed license licenses hereby merchantability disclaims sublicense creativecommons commons permission software released compliance documentation modification permitted distribute lesser conditions clause".split()
#: Bigrams of a notice from which on it is looked for only where its telling bigrams say.
LONG = 30

#: Ends of units.
UNIT_END = r"[.!?;:]*\n|[.!?]+[ \t]+"


def words_of(notice: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", notice.lower())


def bigrams_of(notice: str) -> list[str]:
    w = words_of(notice)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _tells(gram: str) -> int:
    """Place of the bigram's most telling word, or how many there are."""
    return min((TELLING.index(w) for w in gram.split() if w in TELLING), default=len(TELLING))


def necessary(templates: list[tuple[str, str, str]], threshold: Fraction) -> list[list[str]]:
    """Bigrams of each template of which a match has one: one more than may be missing, telling ones first.

    Of a long notice all bigrams with a telling word, if it has any.
    """
    grams = [bigrams_of(t) for _, _, t in templates]
    often = Counter(x for g in grams for x in g)
    least, out = threshold / (2 - threshold), []
    for g in grams:
        telling = [x for x in g if _tells(x) < len(TELLING)]
        ranked = sorted(g, key=lambda x: (_tells(x), -len(max(x.split(), key=len)), often[x], x))
        out.append(telling if telling and len(g) >= LONG else ranked[: floor(len(g) * (1 - least)) + 1])
    return out


def may_match(text: Column, templates: list[tuple[str, str, str]], threshold: Fraction) -> Column:
    """False only for lower-case texts that no template matches: they lack all necessary bigrams."""
    needed = {x for g in necessary(templates, threshold) for x in g}
    words = {TELLING[_tells(x)] for x in needed if _tells(x) < len(TELLING)}
    others = sorted(x for x in needed if not words & set(x.split()))
    out = F.lit(False)
    for w in sorted(w for w in words if not any(v != w and v in w for v in words)):
        out = out | F.contains(text, F.lit(w))
    return out | text.rlike("|".join(x.replace(" ", "[^a-z0-9]+") for x in others)) if others else out


def _bigrams(unit: Column) -> Column:
    w = F.regexp_extract_all(unit, F.lit("[a-z0-9]+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _place(notice: str, gram: str) -> int:
    """How many bigrams of the notice precede it."""
    w = words_of(notice)
    return next(i for i in range(len(w) - 1) if f"{w[i]} {w[i + 1]}" == gram)


def _windows(grams: Column, spots: Column, notices: list[tuple[str, str, str]], threshold: Fraction) -> Column:
    """Matching windows of a run of bigrams that don't overlap: structs of both, dice, i (negative) and start.

    spots: the places (from 1) of all necessary bigrams.
    """
    def of(i: int, notice: str, needed: list[str]) -> Column:
        wide, b = len(words_of(notice)) - 1, bigrams_of(notice)
        at = F.filter(spots, lambda j: F.get(grams, j - 1).isin(needed))
        last = F.greatest(F.size(grams) - wide + 1, F.lit(1))
        within = lambda p: F.greatest(F.least(p, last), F.lit(1))
        if wide < LONG:
            starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(within(p - wide + 1), within(p)))))
        else:
            place = F.create_map(*[F.lit(x) for g in needed for x in (g, _place(notice, g))])
            starts = F.array_distinct(F.transform(at, lambda p: within(p - F.element_at(place, F.get(grams, p - 1)))))

        def shared(s: Column) -> Column:
            g = F.slice(grams, s, wide)
            return F.struct(F.size(F.array_intersect(g, F.array(*map(F.lit, b)))).alias("both"), F.size(F.array_distinct(g)).alias("n"), (-s).alias("start"))

        scored = F.transform(F.transform(starts, shared), lambda x: F.struct(x["both"], (2.0 * x["both"] / (x["n"] + len(b))).alias("dice"), F.lit(-i).alias("i"), x["start"]))
        return F.filter(scored, lambda x: x["dice"] >= float(threshold))

    found = [of(i, x[2], n) for i, (x, n) in enumerate(zip(notices, necessary(notices, threshold), strict=True))]
    long = {-i: len(words_of(x[2])) - 1 for i, x in enumerate(notices)}
    best = F.reverse(F.array_sort(F.flatten(F.array(*found))))
    wide = F.create_map(*[F.lit(x) for kv in long.items() for x in kv])
    ends = lambda x: -x["start"] + F.element_at(wide, x["i"])
    none = F.array().cast("array<struct<both:int,dice:double,i:int,start:int>>")
    free = lambda kept, x: ~F.exists(kept, lambda y: (-y["start"] <= ends(x)) & (-x["start"] <= ends(y)))
    return F.aggregate(best, none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, threshold: Fraction = THRESHOLD, notices: list[tuple[str, str, str]] = [*NOTICES, *BODIES]) -> DataFrame:
    """key, n_notices, licences, kinds, best_dice: one row for each row of docs.

    licences and kinds are sorted, distinct and joined by commas; a unit counts for its best
    template, of equal ones the first listed; windows over the other units count besides.  Without a match (or text) they are empty and
    best_dice is 0.  Null and repeated keys and repeated rows are kept; other columns are ignored,
    whatever their names.  Texts are read whole, however long; an empty table gives no rows.
    """
    t = float(threshold)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sets = [bigrams_of(x[2]) for x in templates]
    least, most = min(floor(low * len(s)) for s in sets), max(-floor(-high * len(s)) for s in sets)
    every = [*templates, *notices]
    phrase = "|".join(sorted({x for g in necessary(every, threshold) for x in g}))

    def best(grams: Column) -> Column:
        found = []
        for i, s in enumerate(sets):
            both = F.size(F.array_intersect(grams, F.array(*map(F.lit, s))))
            fits = (F.size(grams) * low.denominator >= len(s) * low.numerator) & (F.size(grams) * high.denominator <= len(s) * high.numerator)
            dice = F.when(fits, 2.0 * both / (F.size(grams) + len(s))).otherwise(0.0)
            found.append(F.struct(dice.alias("dice"), F.lit(-i).alias("i")))
        return F.array_max(F.array(*found))

    low_text = F.lower(F.col("__t"))
    none = F.array().cast("array<struct<dice:double,i:int>>")
    # the best template of each unit; 0 for units that match none
    of_unit = lambda u: F.when(may_match(u, templates, threshold), _bigrams(u)).otherwise(F.array().cast("array<string>"))
    match = lambda g: F.when(F.size(g).between(least, most), best(g))
    units = F.when(may_match(low_text, every, threshold), F.split(low_text, UNIT_END)).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__t")).select("__k", units.alias("__u"))
    out = out.select("__k", "__u", F.transform(F.transform("__u", of_unit), match).alias("__m"))
    hit = lambda b: F.coalesce(b["dice"] >= t, F.lit(False))
    # what is left, as normalised words; a matched unit becomes a mark that no notice holds
    left = F.array_join(F.zip_with("__u", "__m", lambda u, m: F.when(hit(m), F.lit("|")).otherwise(u)), "\n")
    out = out.select("__k", F.filter("__m", hit).alias("__hits"), F.when(F.size("__u") > 0, F.regexp_replace(left, "[^a-z0-9|]+", " ")).alias("__left"))
    w = F.when(F.col("__left").rlike(rf"\b(?:{phrase})\b"), F.regexp_extract_all("__left", F.lit("[a-z0-9]+|[|]"), F.lit(0)))
    out = out.select("__k", "__hits", w.alias("__w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("__w") - 1), lambda i: F.concat_ws(" ", F.get("__w", i - 1), F.get("__w", i)))
    out = out.select("__k", "__hits", F.when(F.size("__w") > 1, grams).alias("__g"))
    in_some = sorted({x for g in necessary(every, threshold) for x in g})
    spots = F.filter(F.sequence(F.lit(1), F.size("__g")), lambda j: F.get("__g", j - 1).isin(in_some))
    out = out.select("__k", "__hits", "__g", F.when(F.size("__g") > 0, spots).alias("__at"))
    more = F.transform(_windows(F.col("__g"), F.col("__at"), every, threshold), lambda x: F.struct(x["dice"].alias("dice"), x["i"].alias("i")))
    out = out.select("__k", F.concat("__hits", F.when(F.col("__g").isNotNull(), more).otherwise(none)).alias("__hits"))
    names, kinds = F.array(*[F.lit(x[0]) for x in every]), F.array(*[F.lit(x[1]) for x in every])
    joined = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform("__hits", lambda b: F.get(of, -b["i"])))), ",")
    return out.select(
        F.col("__k").alias(key),
        F.size("__hits").cast("long").alias("n_notices"),
        joined(names).alias("licences"),
        joined(kinds).alias("kinds"),
        F.coalesce(F.round(F.array_max(F.transform("__hits", lambda b: b["dice"])), 6), F.lit(0.0)).alias("best_dice"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


SQL = rf"""
WITH templates(i, name, kind, b) AS (VALUES {", ".join(f"({i}, '{n}', '{k}', {_list(bigrams_of(t))})" for i, (n, k, t) in enumerate(TEMPLATES))}),
units AS (
  SELECT doc_id, u, regexp_extract_all(unit, '[a-z0-9]+') AS w
  FROM (SELECT doc_id, unnest(x) AS unit, unnest(range(len(x))) AS u
        FROM (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '{UNIT_END}') AS x FROM documents))),
pairs AS (SELECT DISTINCT doc_id, u, w[i] || ' ' || w[i + 1] AS p FROM (SELECT doc_id, u, w, unnest(range(1, len(w))) AS i FROM units)),
grams AS (SELECT doc_id, u, list(p) AS g FROM pairs GROUP BY 1, 2),
scored AS (
  SELECT doc_id, u, i, name, kind, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice
  FROM grams JOIN templates ON 3 * len(g) >= 2 * len(b) AND 2 * len(g) <= 3 * len(b)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, u ORDER BY dice DESC, i) AS r FROM scored WHERE dice >= 0.8) WHERE r = 1),
agg AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT name)), ',') AS l, array_to_string(list_sort(list(DISTINCT kind)), ',') AS k, round(max(dice), 6) AS d FROM best GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n_notices, coalesce(l, '') AS licences, coalesce(k, '') AS kinds, CAST(coalesce(d, 0) AS DOUBLE) AS best_dice
FROM documents LEFT JOIN agg USING (doc_id)
"""

QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE_SQL = {"op5_license_scan": SQL}
