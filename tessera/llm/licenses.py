"""License scans: whole texts looked up by the digest of a canonical form."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, ascii_lower

#: More known texts than this are joined by shuffle instead of being broadcast.
BROADCAST_TEXTS = 10_000

#: Short public licence texts.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

KNOWN = {
    "MIT": MIT,
    "MIT (titled)": "MIT License\n\nCopyright (c) 2024 The Authors\n\n" + MIT,
    "ISC": ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_DISCLAIMER,
    "0BSD": ISC_GRANT + ".\n\n" + ISC_DISCLAIMER,
    "BSD-2-Clause": BSD_HEAD + BSD_TAIL,
    "BSD-3-Clause": BSD_HEAD + BSD_THIRD + BSD_TAIL,
    "Zlib": ZLIB,
}

#: Spellings that count as one wherever they stand in canonical text, inside longer words too (licences, unmodified).
SPELLINGS = [
    ("licence", "license"), ("favour", "favor"), ("authorise", "authorize"), ("recognise", "recognize"),
    ("organisation", "organization"), ("modifie", "modify"), ("acknowledgement", "acknowledgment"), ("programme", "program"),
    ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("initialise", "initialize"),
]

#: A line that begins with a copyright mark, and a year or the mark (c) behind it; a clause numbered (c) is none.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9])|(?:\(c\)|©)[ \t]*[0-9]{4})[^\n]*"
RESERVED = r"all rights reserved"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Lines in front of a licence, 10 of them at most: a short title that names a licence, any copyright line. For lower-case text.
HEAD_LINE = r"(?:(?:[^\n]{0,60}[^a-z0-9\n])?licen[cs]e(?:[^a-z0-9\n][^\n]{0,30})?|[^a-z0-9\n]*copyright(?:[^a-z0-9\n][^\n]*)?|[ \t]*all rights reserved[^\n]*)"
HEAD_LINES = rf"\A[ \t\n\f]*(?:{HEAD_LINE}\n[ \t\n\f]*){{1,10}}"


def plain_lower(text: Column) -> Column:
    """A-Z in lower case, line ends without carriage returns."""
    return ascii_lower(F.replace(text, F.lit("\r"), F.lit("")))


def canonical(lower: Column) -> Column:
    """Of plain_lower() text: no copyright lines, one blank for all that is neither letter nor digit, one spelling."""
    c = F.regexp_replace(F.regexp_replace(lower, COPYRIGHT_LINE, ""), RESERVED, "")
    c = F.trim(F.regexp_replace(c, NOT_WORD, " "))
    for other, usual in SPELLINGS:
        c = F.replace(c, F.lit(other), F.lit(usual))
    return c


def headless(lower: Column) -> Column:
    """What follows the title and copyright lines at the start."""
    return F.regexp_replace(lower, HEAD_LINES, "")


def full_texts() -> dict[str, str]:
    """KNOWN and the texts of license_texts by their names."""
    return KNOWN | {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def license_scan(docs: DataFrame, known: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest (SHA-256 of the canonical text), license_id (null if none), is_license.

    The whole text must be a known licence, up to canonical form; known are full_texts() by default. A text that
    is none is looked up once more without titles and copyright lines of any form at its start, among the known texts without theirs.
    Of known texts with one digest the smallest name counts. Null text counts as empty, and empty canonical text is never a licence. Ids may be
    null or repeat. Other columns aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    known = full_texts() if known is None else known
    # As Arrow data they become a local table of the plan; a list of rows would start Python workers on the executors.
    columns = [pa.array([x[i] for x in sorted(known.items())], pa.string()) for i in (0, 1)]
    table = spark.createDataFrame(pa.table(columns, names=["license_id", "text"]))

    def names(form: Column, digest: str, name: str) -> DataFrame:
        rows = table.select("license_id", form.alias("c")).where("c <> ''").select(F.sha2("c", 256).alias(digest), "license_id")
        rows = rows.groupBy(digest).agg(F.min("license_id").alias(name))
        return F.broadcast(rows) if len(known) <= BROADCAST_TEXTS else rows

    low = plain_lower(F.col("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("low"))
    rows = rows.select("doc_id", "low", headless(F.col("low")).alias("body"), F.sha2(canonical(F.col("low")), 256).alias("digest"))
    rows = rows.select("doc_id", "digest", F.when(F.col("body") == F.col("low"), F.col("digest")).otherwise(F.sha2(canonical(F.col("body")), 256)).alias("rest"))
    rows = rows.join(names(canonical(low), "digest", "whole_id"), "digest", "left").join(names(canonical(headless(low)), "rest", "rest_id"), "rest", "left")
    license_id = F.coalesce("whole_id", "rest_id")
    return rows.select("doc_id", "digest", license_id.alias("license_id"), license_id.isNotNull().alias("is_license"))


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Known licences among all documents."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"

    def form(low: str) -> str:
        c = f"regexp_replace(regexp_replace({low}, {lit(COPYRIGHT_LINE)}, '', 'g'), {lit(RESERVED)}, '', 'g')"
        c = f"trim(regexp_replace({c}, {lit(NOT_WORD)}, ' ', 'g'))"
        for other, usual in SPELLINGS:
            c = f"replace({c}, {lit(other)}, {lit(usual)})"
        return c

    low = f"replace(translate(text, '{UPPER}', '{LOWER}'), chr(13), '')"
    body = f"regexp_replace(low, {lit(HEAD_LINES)}, '')"
    rows = ", ".join(f"({lit(n)}, {lit(t)})" for n, t in sorted(full_texts().items()))
    return f"""
WITH k AS (SELECT name, {form('low')} AS whole, {form(body)} AS rest FROM (SELECT name, {low} AS low FROM (VALUES {rows}) AS v(name, text))),
wholes AS (SELECT sha256(whole) AS digest, min(name) AS whole_id FROM k WHERE whole <> '' GROUP BY 1),
rests AS (SELECT sha256(rest) AS rest, min(name) AS rest_id FROM k WHERE rest <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256({form('low')}) AS digest, sha256({form(body)}) AS rest FROM (SELECT doc_id, {low} AS low FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))
SELECT doc_id, d.digest, coalesce(whole_id, rest_id) AS license_id, coalesce(whole_id, rest_id) IS NOT NULL AS is_license
FROM d LEFT JOIN wholes ON d.digest = wholes.digest LEFT JOIN rests ON d.rest = rests.rest
"""


OP1_SQL = _sql()
