"""Identity of versioned documents: covers, document codes, editions and release addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How covers of the corpus name their publisher, families and series.
PUBLISHER, FAMILIES, SERIES = "ETSI", "GS|GR|TS|ISG", "MEC"

COVER = rf"{PUBLISHER}\s+(?:{FAMILIES})\s+({SERIES}(?:-DEC)?)\s*(\d+(?:-\d+)?)\s+V(\d+)\.(\d+)\.(\d+)\s*\((\d{{4}}-\d{{2}})\)"


def cover(text: Column) -> Column:
    """spec_id, edition, pub_date and key (major, minor, patch) of a cover text; null if it names none."""
    flat = F.regexp_replace(text, r"\s+", " ")
    part = lambda i: F.regexp_extract(flat, COVER, i)
    key = F.struct(*(part(i).cast("int").alias(n) for i, n in ((3, "major"), (4, "minor"), (5, "patch"))))
    edition = F.concat(F.lit("V"), part(3), F.lit("."), part(4), F.lit("."), part(5))
    found = F.struct(
        F.concat(part(1), F.lit(" "), part(2)).alias("spec_id"), edition.alias("edition"), part(6).alias("pub_date"), key.alias("key")
    )
    return F.when(flat.rlike(COVER), found)


#: Words that end the title on a cover.
TITLE_STOP = r"\b(?:Disclaimer|Keywords|Reference Number|Series|Edition)\b"


def title(text: Column) -> Column:
    """The title behind a cover's identity: up to a word that ends it, or else 140 characters; null if there is none."""
    rest = F.regexp_extract(F.regexp_replace(text, r"\s+", " "), f"{COVER}(.*)$", 7)
    stopped = F.when(rest.rlike(TITLE_STOP), F.regexp_extract(rest, f"^(.*?){TITLE_STOP}", 1)).otherwise(F.substring(rest, 1, 140))
    return F.nullif(F.trim(stopped, F.lit(" ,;.-")), F.lit(""))


#: Fixed value: the number, and the part, in names of the series.
NUMBER = r"(?:MEC|GS|GR)?[_\-\s]?0*([0-9]{1,3})(-[0-9]+)?"


def normal_id(raw: Column) -> Column:
    """mec-3, GS 003 and 3 as MEC003, a part kept: MEC010-2; in upper case as it is, if there is no number."""
    x = F.upper(F.trim(raw))
    return F.when(x.rlike(NUMBER), F.concat(F.lit(SERIES), F.lpad(F.regexp_extract(x, NUMBER, 1), 3, "0"), F.regexp_extract(x, NUMBER, 2))).otherwise(x)


def label(spec_id: Column) -> Column:
    """MEC-003 as MEC003, MEC-DEC-063 as MEC-DEC063."""
    return F.regexp_replace(F.replace(spec_id, F.lit(f"{SERIES}-DEC-"), F.lit(f"{SERIES}-DEC")), rf"^((?:(?!{SERIES}-).)*){SERIES}-(?!DEC)", f"$1{SERIES}")


def colour_group(name: Column) -> Column:
    """Of 20: a name's digits as a number, in tens; 0 without digits."""
    digits = F.regexp_replace(name, r"\D", "")
    return F.when(digits == "", 0).otherwise(F.expr("0") + F.floor(digits.cast("decimal(38,0)") / 10) % 20).cast("int")


def disagrees(cover_id: Column, url_id: Column) -> Column:
    """Both are known, and they don't name one document."""
    return F.coalesce(canonical_id(cover_id) != canonical_id(url_id), F.lit(False))


def canonical_id(code: Column) -> Column:
    """Upper case, parts joined by dashes, letters apart from digits, no leading zeros: 'mec 003-1' is MEC-3-1."""
    x = F.regexp_replace(F.upper(F.trim(code)), r"[\s_]+", "-")
    x = F.regexp_replace(x, r"([A-Z])([0-9])", "$1-$2")
    return F.regexp_replace(x, r"(^|-)0+([0-9])", "$1$2")


def cited_id(code: Column) -> Column:
    """As canonical_id, but the series number keeps three digits; only part numbers lose zeros."""
    x = F.regexp_replace(F.upper(F.trim(plain(code))), r"[\s_-]+", " ")
    x = F.regexp_replace(x, r"([A-Z])([0-9])", "$1 $2")
    number = F.lpad(F.regexp_extract(x, r"([0-9]+)", 1), 3, "0")
    part = F.regexp_extract(x, r"[0-9]+ 0*([0-9]+)", 1)
    head = F.trim(F.regexp_extract(x, r"^([A-Z ]+)", 1))
    return F.concat(head, F.lit(" "), number, F.when(part != "", F.concat(F.lit("-"), part)).otherwise(""))


#: Typographic spaces, and dashes.
SPACES_LIKE = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000"
DASHES_LIKE = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\uff0d"


def plain(text: Column) -> Column:
    """Typographic spaces and dashes as plain ones; no character moves."""
    return F.translate(text, SPACES_LIKE + DASHES_LIKE, " " * len(SPACES_LIKE) + "-" * len(DASHES_LIKE))


def release_id(url: Column) -> Column:
    """Code in a release's file name (five digits: number and part); null if there is none."""
    name = F.lower(F.substring_index(url, "/", -1))
    digits = F.regexp_extract(name, r"^[a-z]+_[a-z]+(\d{3,5})", 1)
    return (
        F.when(F.length(digits) == 5, F.concat(F.lit(f"{SERIES}-"), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 2)))
        .when(F.length(digits) == 3, F.concat(F.lit(f"{SERIES}-"), digits))
    )


def release_version(url: Column) -> Column:
    """(major, minor, patch) from v010203 in the address; zeros if there is none. Structs compare as versions do."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(F.lower(url), r"v(\d\d)(\d\d)(\d\d)", i), F.lit("")).cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def is_release(url: Column) -> Column:
    return F.lower(url).endswith(".pdf") & F.lower(url).contains("/deliver/")


def mislabeled(stem: Column, spec: Column) -> Column:
    """Both names hold a number of three digits, and not the same."""
    a, b = (F.regexp_extract(x, r"(?:^|[^0-9])(\d{3})(?:[^0-9]|$)", 1) for x in (stem, spec))
    return (a != "") & (b != "") & (a != b)


def edition_matches(claimed: Column, edition: Column) -> Column:
    """Equal, or a dotted prefix: 3.1 stands for V3.1.1, 3.1 not for V3.11.1."""
    a, b = F.ltrim(F.lower(claimed), F.lit("v")), F.ltrim(F.lower(edition), F.lit("v"))
    return (a == b) | F.startswith(b, F.concat(a, F.lit(".")))


def file_name(label_: Column, original: Column, title_: Column, edition: Column) -> Column:
    """label-edition-title.pdf: the title's words, at most 60 characters, cut between words; the original name without a label."""
    slug = F.regexp_replace(F.regexp_replace(F.coalesce(title_, F.lit("")), r"[^\p{L}\p{N}_ ;().-]", ""), "[ ;]+", "-")
    slug = F.trim(slug, F.lit("-."))
    slug = F.when(F.length(slug) > 60, F.regexp_extract(F.substring(slug, 1, 60), "^(.*?)(?:-[^-]*)?$", 1)).otherwise(slug)
    name = F.concat_ws("-", label_, F.nullif(edition, F.lit("")), F.nullif(slug, F.lit("")))
    return F.when(F.coalesce(label_, F.lit("")) == "", original).otherwise(F.concat(name, F.lit(".pdf")))
