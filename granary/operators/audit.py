"""Citation audit: are the pages that an answer cites among the excerpts that it was given?"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.identity import SERIES, cited_id, edition_matches, plain

#: Characters between a page and the code that it belongs to; between a page and an edition before or after it.
NEAR, EDITION_BACK, EDITION_ON = 120, 60, 24
CANNED_WORDS = 40

#: A code has three digits, and may have a part; pages are cited as
#: p. 5, pp 5-7, page 5: the group tells the short form; the last page of a range is cited, too.
_CODE = rf"\b{SERIES}(?:[ -]?DEC)?[ -]?\d{{3}}(?:[ -]?\d{{1,2}}\b)?"
_PAGE = r"\b(?:(pp?)\s*\.?\s*|pages?\s+)(\d{1,4})(?:\s*-\s*(\d{1,4}))?"
_EDITION = r"\b[Vv](\d+(?:\.\d+){1,3})\b"
_SPAN = "struct<value:string,start:int,end:int>"
SPANS = f"struct<codes:array<{_SPAN}>,editions:array<{_SPAN}>,pages:array<struct<cited:array<int>,short:boolean,start:int,end:int>>>"


def cites_of(text: str, names: Sequence[str]) -> dict[str, list[dict]]:
    """Codes, editions and pages of a text with plain spaces and dashes, and where they stand. names: documents that have
    no code of the series, which are cited by these names."""
    code = re.compile("|".join([_CODE, *(re.escape(n) for n in sorted(names, key=len, reverse=True))]), re.I)
    return {
        "codes": [{"value": m[0], "start": m.start(), "end": m.end()} for m in code.finditer(text)],
        "editions": [{"value": m[1], "start": m.start(), "end": m.end()} for m in re.finditer(_EDITION, text)],
        "pages": [
            {"cited": [int(m[2]), *([int(m[3])] if m[3] else [])], "short": bool(m[1]), "start": m.start(), "end": m.end(2)} for m in re.finditer(_PAGE, text, re.I)
        ],
    }


def _cites(text: Column, names: Column) -> Column:
    """cites_of as a column."""

    @F.pandas_udf(SPANS)
    def cites(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [cites_of(t or "", [n for n in (x if x is not None else []) if n]) for t, x in zip(texts, names, strict=True)]
        return pd.DataFrame(rows, columns=["codes", "editions", "pages"])

    return cites(text, names)


def document_key(code: Column) -> Column:
    """Codes of the series as cited_id writes them; other names in upper case, white space made dashes."""
    flat = plain(code)
    return F.when(F.regexp_like(flat, F.lit(f"(?i)^{_CODE}$")), cited_id(flat)).otherwise(F.regexp_replace(F.upper(F.trim(flat)), r"\s+", "-"))


def excerpt_pages(excerpts: DataFrame) -> DataFrame:
    """answer_id, code, pages, editions: what each answer was given of each document, from the excerpts with identity and page."""
    known = excerpts.where((F.col("spec_id") != "") & F.col("page").isNotNull())
    known = known.select("answer_id", document_key(F.col("spec_id")).alias("code"), F.col("page").cast("int").alias("page"), F.nullif("edition", F.lit("")).alias("edition"))
    return known.groupBy("answer_id", "code").agg(F.collect_set("page").alias("pages"), F.collect_set("edition").alias("editions"))


def complaints(answers: DataFrame, excerpts: DataFrame) -> DataFrame:
    """answer_id, position, complaint: what the excerpts don't support, each once. answers: answer_id, answer; excerpts:
    answer_id, spec_id, edition, page.

    A page belongs to the nearest code of its answer, `p.` rather to one before it, a spelled-out page to one after it.
    Farther than 120 characters, it names no document. Documents without a code of the series are known by their own names.
    Both ends of a range are cited. The edition is the first named between code and page, or else shortly after the page.
    Answers without any excerpt that has both an identity and a page get no complaints. Spans are found by a function; what
    belongs to what are expressions on one answer's lists, and one join.
    """
    given = excerpt_pages(excerpts)
    coded = F.regexp_like(plain(F.col("spec_id")), F.lit(f"(?i)^{_CODE}$"))
    names = excerpts.where((F.col("spec_id") != "") & F.col("page").isNotNull())
    names = names.groupBy("answer_id").agg(F.collect_set(F.when(~coded, plain(F.col("spec_id")))).alias("names"))
    found = answers.join(names, "answer_id").select("answer_id", _cites(plain(F.col("answer")), F.col("names")).alias("s"))
    cites = found.select("answer_id", "s.codes", "s.editions", F.explode("s.pages").alias("p"))
    p = F.col("p")

    def nearness(c: Column) -> Column:
        gap = F.when(p.short, c["start"] - p.end).otherwise(p.start - c["end"])
        apart = F.least(F.abs(c["start"] - p.start), F.abs(c["end"] - p.start))
        return F.struct(F.greatest(gap, F.lit(0)).alias("gap"), apart.alias("apart"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"))

    cites = cites.withColumn("c", F.array_min(F.transform("codes", nearness)))
    c = F.col("c")
    back = F.filter("editions", lambda e: (e["start"] >= F.greatest(c.end, p.start - EDITION_BACK)) & (e["end"] <= p.start))
    later = F.array_min(F.transform(F.filter("codes", lambda x: (x["start"] >= p.end) & (x["start"] != c.start)), lambda x: x["start"]))
    on = F.filter("editions", lambda e: (e["start"] >= p.end) & (e["start"] <= p.end + EDITION_ON) & (later.isNull() | (e["start"] < later)))
    claimed = F.coalesce(F.try_element_at(back, F.lit(1)), F.try_element_at(on, F.lit(1)))["value"]
    code = F.when(c.apart <= NEAR, document_key(c.value))
    cites = cites.select("answer_id", p.start.alias("position"), p.cited.alias("cited"), code.alias("code"), claimed.alias("claimed"))
    joined = cites.join(given, ["answer_id", "code"], "left")
    page = lambda x, what: F.concat_ws(" ", "code", F.concat(F.lit("p."), x.cast("string"), F.lit(f": {what}")))
    pages = (
        F.when(F.col("code").isNull(), F.array(page(F.col("cited")[0], "no specification named")))
        .when(F.col("pages").isNull(), F.transform("cited", lambda x: page(x, "not retrieved")))
        .otherwise(F.transform(F.filter("cited", lambda x: ~F.array_contains("pages", x)), lambda x: page(x, "page not in its excerpts")))
    )
    other = F.col("claimed").isNotNull() & (F.size("editions") > 0) & ~F.exists("editions", lambda e: edition_matches(F.col("claimed"), e))
    edition = F.when(other, F.array(F.concat("code", F.lit(" V"), "claimed", F.lit(": edition not in its excerpts")))).otherwise(F.array().cast("array<string>"))
    rows = joined.select("answer_id", "position", F.explode(F.concat(pages, edition)).alias("complaint"))
    return rows.groupBy("answer_id", "complaint").agg(F.min("position").alias("position"))


def verdicts(answers: DataFrame, excerpts: DataFrame) -> DataFrame:
    """answer_id, cites, complaints, verdict: skipped (no excerpt has identity and page), unsupported, canned (short and without
    cites), none, or all present."""
    n = F.size(F.regexp_extract_all(plain(F.col("answer")), F.lit(f"(?i){_PAGE}"), F.lit(0)))
    found = complaints(answers, excerpts).groupBy("answer_id").agg(F.count("*").alias("complaints"))
    known = excerpts.where((F.col("spec_id") != "") & F.col("page").isNotNull()).select("answer_id").distinct().withColumn("_known", F.lit(True))
    rows = answers.join(found, "answer_id", "left").join(known, "answer_id", "left")
    short = F.regexp_count("answer", F.lit(r"\S+")) < CANNED_WORDS
    verdict = (
        F.when(F.col("_known").isNull(), "skipped").when(F.col("complaints") > 0, "unsupported").when((n == 0) & short, "canned").when(n == 0, "none").otherwise("all present")
    )
    return rows.select("answer_id", F.coalesce(n, F.lit(0)).alias("cites"), F.coalesce("complaints", F.lit(0)).alias("complaints"), verdict.alias("verdict"))
