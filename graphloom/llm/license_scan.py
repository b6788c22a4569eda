"""Licence scan by sentence rules. SQL functions only.

A text is cut at line ends and after `.`, `!`, `?` or `:` before white space; fragments are lower-cased, runs of
other characters than a-z and 0-9 become one space, and empty fragments go. A fragment that begins like a
known sentence is compared with them, alone and joined with those after it (sentences wrap over lines), the
longest match first. The identifiers of known sentences, in order and without what lies between, are matched
against ordered rules: a rule applies where its identifiers follow one another.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    3: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    4: 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    5: "See the License for the specific language governing permissions and limitations under the License.",
    10: "Released under the MIT License.",
    11: "Licensed under the MIT License.",
    12: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    13: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    14: 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    15: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    20: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    21: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    22: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    23: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    30: "This work is licensed under the GNU General Public License, version 3.",
    31: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    32: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    33: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    34: "See the GNU General Public License for more details.",
    40: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    41: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    50: "Licensed under CC BY-NC 4.0.",
    51: "Licensed under CC BY 4.0.",
    52: "Licensed under CC BY-SA 4.0.",
    53: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    54: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    60: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    70: "This is free and unencumbered software released into the public domain.",
}

# Fixed values: (rule, licence, identifiers in order).
RULES = [
    ("apache-2.0-short", "Apache-2.0", (1,)),
    ("apache-2.0-header", "Apache-2.0", (2, 3, 4, 5)),
    ("mit-short", "MIT", (10,)),
    ("mit-reference", "MIT", (11,)),
    ("mit-text", "MIT", (12, 13, 14, 15)),
    ("bsd-2-clause", "BSD-2-Clause", (20, 21, 22)),
    ("bsd-3-clause", "BSD-3-Clause", (20, 21, 22, 23)),
    ("gpl-3.0-short", "GPL-3.0-only", (30,)),
    ("gpl-3.0-notice", "GPL-3.0-or-later", (31, 33, 34)),
    ("gpl-2.0-notice", "GPL-2.0-or-later", (32, 33, 34)),
    ("mpl-2.0-notice", "MPL-2.0", (40, 41)),
    ("cc-by-nc-4.0", "CC-BY-NC-4.0", (50,)),
    ("cc-by-4.0", "CC-BY-4.0", (51,)),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0", (52,)),
    ("cc-by-4.0-work", "CC-BY-4.0", (53,)),
    ("cc-by-nc-4.0-work", "CC-BY-NC-4.0", (54,)),
    ("isc-grant", "ISC", (60,)),
    ("unlicense", "Unlicense", (70,)),
]

_END = r"([.!?:])\s+"


def normal(sentence: str) -> str:
    """One normalised sentence, as the scan makes it."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


@lru_cache(1)
def known() -> dict[str, int]:
    return {normal(s): i for i, s in SENTENCES.items()}


#: Most fragments that a known sentence can be wrapped over: each has a word at least.
WRAP = max(len(s.split()) for s in known())


def starts() -> list[str]:
    """The first two words of known sentences."""
    return sorted({" ".join(k.split()[:2]) for k in known()})


def _marks(ids: tuple[int, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _fragments(text: Column) -> Column:
    cut = F.split(F.regexp_replace(text, _END, "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda x: F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))), lambda x: x != "")


def _begin(fragment: Column) -> Column:
    return F.substring_index(fragment, " ", 2)


def identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, marks) of rows of docs (doc_id, text) with known sentences: their identifiers as <1><2>..."""
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    firsts = F.array(*[F.lit(x) for x in starts()])
    # exploded from an array of one: else the optimizer would cut the text anew for each use of f
    frags = docs.select("doc_id", F.explode(F.array(_fragments(F.col("text")))).alias("f"))
    # a wrapped sentence may break after its first word, hence the second fragment
    opening = lambda i: _begin(F.concat_ws(" ", F.get("f", i), F.get("f", i + 1)))
    places = F.filter(F.sequence(F.lit(0), F.size("f") - 1), lambda i: F.array_contains(firsts, opening(i)))
    frags = frags.filter(F.size("f") > 0).withColumn("at", F.explode(F.array(places))).filter(F.size("at") > 0)

    def match(i: Column) -> Column:
        found = F.filter(F.transform(F.sequence(F.lit(WRAP), F.lit(1), F.lit(-1)), lambda k: F.try_element_at(table, F.concat_ws(" ", F.slice("f", i + 1, k)))), lambda x: x.isNotNull())
        return F.get(found, F.lit(0))

    ids = F.filter(F.transform("at", match), lambda x: x.isNotNull())
    return frags.select("doc_id", F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x.cast("string"), F.lit(">"))), "").alias("marks")).filter("marks <> ''")


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, license, n_matches), a row for each rule that applies to a row of docs (doc_id, text).

    Null, empty and unlicensed texts have no rows; null and repeated ids keep theirs; other columns are not
    read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(x).alias("license"), F.lit(_marks(i)).alias("ids")) for r, x, i in RULES])
    counted = F.transform(rules, lambda r: F.struct(r["rule"].alias("rule"), r["license"].alias("license"), ((F.length("marks") - F.length(F.replace(F.col("marks"), r["ids"], F.lit("")))) / F.length(r["ids"])).cast("long").alias("n_matches")))
    return identifiers(base).select("doc_id", F.inline(F.filter(counted, lambda r: r["n_matches"] > 0)))


def oracle() -> str:
    """DuckDB SQL for license_scan of documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    sentences = ", ".join(f"({quote(s)}, {i})" for s, i in known().items())
    rules = ", ".join(f"({quote(r)}, {quote(x)}, {quote(_marks(i))})" for r, x, i in RULES)
    ends = " UNION ALL ".join(f"SELECT doc_id, i, {k} AS k, array_to_string(f[i:i + {k - 1}], ' ') AS s FROM places" for k in range(1, WRAP + 1))
    return rf"""
WITH known(s, id) AS (VALUES {sentences}), rules(rule, license, ids) AS (VALUES {rules}),
frags AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?:])\s+', '\1' || chr(10), 'g'), chr(10)),
          lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS f FROM documents WHERE text IS NOT NULL),
starts AS (SELECT DISTINCT array_to_string(string_split(s, ' ')[1:2], ' ') AS b FROM known),
places AS (SELECT doc_id, f, i FROM (SELECT doc_id, f, unnest(range(1, len(f) + 1)) AS i FROM frags)
           WHERE array_to_string(string_split(array_to_string(f[i:i + 1], ' '), ' ')[1:2], ' ') IN (SELECT b FROM starts)),
tries AS ({ends}),
hits AS (SELECT t.doc_id, t.i, arg_max(known.id, t.k) AS id FROM tries t JOIN known ON known.s = t.s GROUP BY t.doc_id, t.i),
marks AS (SELECT doc_id, string_agg('<' || id || '>', '' ORDER BY i) AS m FROM hits GROUP BY doc_id)
SELECT doc_id, rule, license, CAST((length(m) - length(replace(m, ids, ''))) // length(ids) AS BIGINT) AS n_matches
FROM marks, rules WHERE contains(m, ids)
"""
