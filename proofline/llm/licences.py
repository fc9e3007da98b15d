"""Licence scan: canonical digests of entire texts, hash-joined to the digests of known licences and notices.

Canonical form: lower case, whole copyright lines removed, equivalent spellings made one, every run of characters that
are neither letters nor digits one blank, no blanks at the ends; its SHA-256 is the digest. A text is looked up as a
whole, and so is each of its lines, as a notice often stands in a text as a line of its own. The known texts take the
same path, so the two sides cannot drift apart. DataFrame functions only; the lookup is an equi-join that the planner
broadcasts when the table of known texts is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators.fence import fenced

from .common import staged

#: Public licence texts and notices. Names are SPDX-like.
KNOWN = {
    "CC-BY-NC-4.0 notice": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0 notice": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0 notice": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0 notice": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-3.0 notice": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0 notice": ["This work is licensed under the GNU General Public License, version 2."],
    "Apache-2.0 notice": ["Licensed under the Apache License, Version 2.0."],
    "MIT notice": ["Released under the MIT License.", "Licensed under the MIT License."],
    "BSD-3-Clause notice": ["Released under the BSD 3-Clause License."],
    "all rights reserved": ["All rights reserved."],
    "MIT": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""],
    "0BSD": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""],
    "Zlib": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""],
}
#: Spellings that count as the same word, (written, canonical).
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
             ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"),
             ("favour", "favor"), ("honour", "honor"), ("labour", "labor"), ("per cent", "percent"), ("whilst", "while"),
             ("copyright owner", "copyright holder"), ("ver", "version")]
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*(\([c]\)|©|:|[0-9]{4})|\([c]\)[ \t]*[0-9]{4}|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Canonical form with line ends kept, one blank at both ends of every line."""
    x = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", " ")
    x = F.concat(F.lit(" "), F.replace(x, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for written, same in SPELLINGS:
        x = F.replace(x, F.lit(f" {written} "), F.lit(f" {same} "))
    return x


def digest(canonical_text: Column) -> Column:
    """SHA-256 of a canonical form as one line; null for an empty one."""
    flat = F.btrim(F.regexp_replace(canonical_text, " *\n[ \n]*", " "))
    return F.when(flat != "", F.sha2(flat, 256))


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """digest, license; a digest that several names share carries the first of them."""
    rows = [(name, text) for name, texts in (KNOWN if known is None else known).items() for text in texts]
    frame = spark.createDataFrame(rows, "license string, text string")
    return frame.select("license", digest(canonical(F.col("text"))).alias("digest")).filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license (of the entire text), notices (names of matching lines, sorted, joined by ``|``).

    One row per distinct (id, digest). A null text, or one without letters and digits, has a null digest and no match.
    A null id is kept. Other columns are not read.
    """
    known = known.select("digest", "license")
    base = fenced(docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("c")), ["c"])
    lines = F.filter(F.transform(F.array_distinct(F.split("c", "\n")), lambda x: F.unhex(digest(x))), lambda x: x.isNotNull())
    # the texts are read once; what stays is one digest per text and line
    base = staged(base.select("doc_id", digest(F.col("c")).alias("whole"), lines.alias("lines")), "digests")
    whole = base.select("doc_id", F.col("whole").alias("digest")).distinct().join(known, "digest", "left")
    by_line = base.select("doc_id", "whole", F.explode("lines").alias("line"))
    lines = by_line.join(known.select(F.unhex("digest").alias("line"), "license"), "line")
    notices = lines.groupBy(F.col("doc_id").alias("id"), "whole").agg(F.array_join(F.array_sort(F.collect_set("license")), "|").alias("notices"))
    joined = whole.join(notices, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("digest").eqNullSafe(F.col("whole")), "left")
    return joined.select("doc_id", "digest", "license", "notices")


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    x = f"regexp_replace(lower({text}), {_sql(_COPYRIGHT)}, '', 'g')"
    x = f"' ' || replace(regexp_replace({x}, {_sql(r'[^\p{L}\p{N}\n]+')}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for written, same in SPELLINGS:
        x = f"replace({x}, ' {written} ', ' {same} ')"
    return x


def _digest_sql(c: str) -> str:
    flat = f"trim(regexp_replace({c}, ' *\\n[ \\n]*', ' ', 'g'))"
    return f"CASE WHEN {flat} <> '' THEN sha256({flat}) END"


def oracle() -> str:
    """DuckDB SQL for :func:`scan` of ``documents``."""
    values = ", ".join(f"({_sql(name)}, {_sql(t)})" for name, texts in KNOWN.items() for t in texts)
    return f"""WITH known AS (SELECT {_digest_sql('c')} AS digest, min(license) AS license FROM (SELECT license, {_canonical_sql('text')} AS c
  FROM (VALUES {values}) AS v(license, text)) GROUP BY 1),
 base AS MATERIALIZED (SELECT doc_id, c, {_digest_sql('c')} AS digest FROM (SELECT doc_id, {_canonical_sql('text')} AS c FROM documents)),
 lines AS (SELECT doc_id, digest AS whole, {_digest_sql('line')} AS digest FROM (SELECT doc_id, digest, unnest(string_split(c, chr(10))) AS line FROM base)),
 notices AS (SELECT doc_id, whole, string_agg(DISTINCT license, '|' ORDER BY license) AS notices FROM lines JOIN known USING (digest) GROUP BY 1, 2)
 SELECT w.doc_id, w.digest, k.license, n.notices FROM (SELECT DISTINCT doc_id, digest FROM base) w LEFT JOIN known k ON k.digest = w.digest
 LEFT JOIN notices n ON n.doc_id IS NOT DISTINCT FROM w.doc_id AND n.whole IS NOT DISTINCT FROM w.digest"""
