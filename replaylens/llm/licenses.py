"""Licence scan: canonical digests of whole texts and of notice lines, hash-joined to known digests.

A text is made canonical (case, copyright lines, punctuation, white space, equivalent spellings), its SHA-256
is the key, and known licences are keyed in the same way. Everything is a built-in expression: the scan is one
pass without a shuffle for whole texts; only lines that are a known notice are grouped by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of public licences and notices, and what each asks of a user.
KNOWN = [
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", "SPDX-License-Identifier: MIT"),
    ("MIT", "permissive", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("ISC", "permissive", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", "permissive", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "permissive", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-only", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "copyleft", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "copyleft", """This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("CC-BY-NC-4.0", "non-commercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "non-commercial",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "permissive",
     "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

# Spellings that count as the same word, applied after punctuation has become one space.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("https", "http"), ("merchantibility", "merchantability"), ("organisation", "organization"),
    ("authorised", "authorized"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("whilst", "while"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("fulfil", "fulfill"), ("wilful", "willful"),
]

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|<)|\(c\)[ \t]*[0-9]|©)[^\n]*$"
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The text in lower case, without copyright lines, words one space apart, with one spelling for each word."""
    text = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, NOT_A_WORD, " ")), F.lit(" "))
    for other, usual in SPELLINGS:
        text = F.replace(text, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(text)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, known=None) -> DataFrame:
    """(digest, license, terms), one row per digest. As many rows as the parameter has: safe to broadcast."""
    rows = spark.createDataFrame(list(KNOWN if known is None else known), "license string, terms string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(
        F.min("license").alias("license"), F.min_by("terms", "license").alias("terms"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Licences of each document of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, text_digest (of the canonical whole text), text_license (the licence that the whole text is,
    else null), notices (licences that single lines are, distinct, sorted, comma-separated; '' if none),
    n_notice_lines long, restricted boolean (a copyleft or non-commercial licence was found).

    Null text counts as empty: no licence. Rows are kept one for one; rows that share a doc_id share the notices
    of all of them, and those with a null doc_id too. Empty input gives no rows.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = known.select(F.col("digest").alias("text_digest"), "license", "terms")
    whole = docs.select("doc_id", digest(F.col("text")).alias("text_digest")).join(
        F.broadcast(known), "text_digest", "left")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", digest(F.col("line")).alias("text_digest")).join(F.broadcast(known), "text_digest")
    found = lines.groupBy(F.col("doc_id").alias("in_doc")).agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"),
        F.count("*").alias("n_notice_lines"), F.max(F.col("terms") != "permissive").alias("restrictive"))
    return whole.join(found, F.col("doc_id").eqNullSafe(F.col("in_doc")), "left").select(
        "doc_id", "text_digest", F.col("license").alias("text_license"),
        F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notice_lines", F.lit(0)).cast("long").alias("n_notice_lines"),
        (F.coalesce(F.col("terms") != "permissive", F.lit(False))
         | F.coalesce("restrictive", F.lit(False))).alias("restricted"))


def _sql_canonical(text: str) -> str:
    word = f"regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g'), '{NOT_A_WORD}', ' ', 'g')"
    word = f"' ' || trim({word}) || ' '"
    for other, usual in SPELLINGS:
        word = f"replace({word}, ' {other} ', ' {usual} ')"
    return f"trim({word})"


def oracle_sql() -> str:
    """DuckDB SQL of ``scan_licenses(documents)``."""
    values = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in KNOWN)
    return f"""
with raw(license, terms, text) as (values {values}),
known as (select sha256({_sql_canonical('text')}) as digest, min(license) as license, arg_min(terms, license) as terms
          from raw group by 1),
docs as (select doc_id, coalesce(text, '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from docs),
found as (select doc_id, string_agg(distinct license, ',' order by license) as notices, count(*) as n,
                 bool_or(terms <> 'permissive') as r
          from lines join known on sha256({_sql_canonical('line')}) = digest group by 1),
whole as (select doc_id, sha256({_sql_canonical('text')}) as text_digest from docs)
select w.doc_id, w.text_digest, k.license as text_license, coalesce(f.notices, '') as notices,
       coalesce(f.n, 0)::bigint as n_notice_lines,
       coalesce(k.terms <> 'permissive', false) or coalesce(f.r, false) as restricted
from whole w left join known k on k.digest = w.text_digest
left join found f on f.doc_id is not distinct from w.doc_id"""
