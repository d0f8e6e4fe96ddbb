"""Licence scan: entire texts, and entire lines, are looked up by canonical digest among known licences.

DataFrame functions only. Canonical form: lower case, copyright lines dropped, equivalent spellings made one, runs of
white space and ASCII or typographic punctuation made one space. The digest is the SHA-256 of that.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_column

#: Spellings that licence matching treats as one (left: found, right: kept), as regular expressions.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorised", "authorized"),
    ("catalogue", "catalog"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("https:", "http:"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("recognised", "recognized"),
    ("sub-license", "sublicense"),
    ("whilst", "while"),
]

#: Licence texts and notices as their owners publish them (public texts).
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
TEXTS = [
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.\n\n" + _WARRANTY,
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        + _ISC_WARRANTY,
    ),
    (
        "0BSD",
        "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted.\n\n" + _ISC_WARRANTY,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
#: A line that holds none of these can't be a known notice of one line (the known ones all hold one; a test checks it).
HINTS = ("licens", "licenc")

#: As HINTS, for the whole texts too: those that don't speak of a licence hold this word.
MORE_HINTS = (*HINTS, "provided")
#: A first line that is only the name of what follows.
TITLED = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib")
_END = "END OF TERMS AND CONDITIONS"

_COPYRIGHT = r"(^|\n)[^\na-z0-9]*(copyright|\(c\)|©)[^\n]*"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2026}\x{00A0}]+"


def canonical(text: Column) -> Column:
    text = F.regexp_replace(F.lower(text), _COPYRIGHT, "\n")
    text = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, text)
    return F.trim(F.regexp_replace(text, _GAP, " "))


def digest(text: Column) -> Column:
    """Null where nothing is left to compare."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the folder license_texts, and of the texts at hand without their title or what follows their terms."""
    out = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    bare = [(n, t.split("\n\n", 1)[1]) for n, t in [*TEXTS, *out] if n in TITLED and "\n\n" in t]
    return [*out, *bare, *((n, t[: t.index(_END) + len(_END)]) for n, t in out if _END in t)]


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_digest, license: one row a digest; of several names the first in code point order."""
    rows = spark.createDataFrame([*TEXTS, *whole_texts()] if texts is None else texts, "license string, body string")
    return rows.groupBy(digest(F.col("body")).alias("license_digest")).agg(F.min("license").alias("license")).dropna()


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, digest, license (the known licence that the entire text is, or null), notices (the known
    licences that entire lines are, sorted, joined by a comma; null if none), notice_lines (how many such lines).

    Null and empty texts, and texts of punctuation alone, have no digest and match nothing. Null ids are kept. Rows equal in
    id and text get equal results. The known digests join by hash; Spark broadcasts them only while they are under its
    autoBroadcastJoinThreshold, as the size of that table is the caller's. Other columns of docs are not looked at.
    """
    # of a caller's list nothing is known, so all lines are looked up
    hinted = (lambda x: reduce(lambda a, b: a | b, (F.lower(x).contains(h) for h in MORE_HINTS))) if known is None else (lambda x: F.lit(True))
    known = known_licenses(docs.sparkSession) if known is None else known
    text = text_column()
    rows = docs.select("doc_id", text.alias("_text"))
    whole = rows.select("doc_id", F.xxhash64("_text").alias("_row"), digest(F.col("_text")).alias("digest"))
    lines = (
        rows.where(hinted("_text"))
        .select("doc_id", F.xxhash64("_text").alias("_row"), F.posexplode(F.split("_text", "\n")).alias("_no", "_line"))
        .where(hinted("_line"))
        .select("doc_id", "_row", "_no", digest(F.col("_line")).alias("license_digest"))
        .join(known, "license_digest")
        .groupBy("doc_id", "_row")
        .agg(
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"),
            F.countDistinct("_no").alias("notice_lines"),
        )
    )
    n = lines.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_key"), "notices", "notice_lines")
    return (
        whole.join(known, F.col("digest") == F.col("license_digest"), "left")
        .join(n, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key")), "left")
        .select("doc_id", "digest", "license", "notices", F.coalesce("notice_lines", F.lit(0)).cast("long").alias("notice_lines"))
    )


def scan_sql() -> str:
    """The same in DuckDB's SQL, with the same known texts and hints."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"regexp_replace(lower({x}), {q(_COPYRIGHT)}, chr(10), 'g')"
        for a, b in SPELLINGS:
            x = f"replace({x}, {q(a)}, {q(b)})"
        return f"trim(regexp_replace({x}, {q(_GAP)}, ' ', 'g'))"

    sha = lambda x: f"CASE WHEN {form(x)} <> '' THEN sha256({form(x)}) END"
    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in [*TEXTS, *whole_texts()])
    hint = lambda x: " OR ".join(f"contains(lower({x}), {q(h)})" for h in MORE_HINTS)
    return f"""
    WITH known AS (SELECT {sha("body")} AS license_digest, min(license) AS license FROM (VALUES {values}) v(license, body) GROUP BY 1),
    rows_ AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS no FROM rows_ WHERE {hint("t")}),
    hits AS (SELECT doc_id, no, license FROM lines JOIN known ON license_digest = {sha("line")}),
    n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(DISTINCT no) AS notice_lines FROM hits GROUP BY doc_id),
    d AS (SELECT doc_id, {sha("t")} AS digest FROM rows_)
    SELECT d.doc_id, d.digest, k.license, n.notices, coalesce(n.notice_lines, 0)::BIGINT AS notice_lines
    FROM d LEFT JOIN known k ON d.digest = k.license_digest LEFT JOIN n ON n.doc_id = d.doc_id"""
