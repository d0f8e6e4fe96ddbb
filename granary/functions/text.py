"""Text expressions. White space and word characters are ASCII throughout, as in the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import FAMILIES, PUBLISHER, SERIES

TOKEN, WORD, IMAGE = "[a-z0-9]+", r"\S+", r"!\[[^\]]*\]\([^)]*\)"
BREAK = r"<br\s*/?>"
#: What is stripped from both ends of a line before it is looked at. Underscores stay: with them a line is a footer.
MARKUP = r"^[\s#*>`~.-]+|[\s#*>`~.-]+$"
#: Whole lines that say nothing of their page, which are footers, page numbers and running titles.
FURNITURE = rf"_+{PUBLISHER}_+|\d{{1,4}}|(?i:{PUBLISHER}\s+(?:{FAMILIES})\s+{SERIES}.*\bV\d+\.\d+\.\d+\b.*)"


def lowered(text: Column) -> Column:
    """The text in lower case, each letter as one: a dotted capital I is an i, without a combining dot that would cut its word."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text; other letters cut words."""
    return F.regexp_extract_all(lowered(text), F.lit(TOKEN), F.lit(0))


def token_id(token: Column) -> Column:
    """CRC-32 of the token, 31 bits; tokens with equal ids count as one."""
    return F.crc32(F.encode(token, "UTF-8")).bitwiseAND(0x7FFFFFFF)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def estimate_tokens(text: Column) -> Column:
    """Words, plus one for each cell border and two for each line break tag."""
    return word_count(text) + F.regexp_count(text, F.lit(r"\|")) + 2 * F.regexp_count(F.lower(text), F.lit(BREAK))


def fingerprint(text: Column, length: int | None = None) -> Column:
    """MD5 of the text without image references, white space made single spaces; of its first characters, if asked."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, IMAGE, ""), r"\s+", " "))
    return F.md5(bare if length is None else F.substring(bare, 1, length))


def quota_bucket(md5: Column, doc_id: Column, text: Column) -> Column:
    """The first of these that is neither null nor empty: content digest, document, the text's first 40 characters."""
    return F.coalesce(F.nullif(md5, F.lit("")), F.nullif(doc_id, F.lit("")), F.substring(text, 1, 40))


def joined(*parts: Column, sep: str = " ") -> Column:
    """The parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def context_text(spec: Column, edition: Column, clause: Column, heading: Column, body: Column) -> Column:
    """What is embedded for a chunk: its place in the corpus, then its body on a line of its own."""
    return joined(joined(spec, edition, clause, heading), body, sep="\n")


def source_label(spec: Column, filename: Column, edition: Column, page: Column) -> Column:
    name = F.coalesce(F.nullif(spec, F.lit("")), F.nullif(filename, F.lit("")), F.lit("unknown"))
    return joined(name, edition, F.when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string"))))


def heading(text: Column) -> Column:
    """The text's first line that begins with #, without them; empty if none."""
    return F.trim(F.regexp_extract(text, r"(?:^|\n)[ \t]*#+([^\n]*)", 1))


def image_refs(text: Column) -> Column:
    """Paths of all image references, with forward slashes."""
    found = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit("\\"), F.lit("/")))


def carries_signal(text: Column, furniture: str = FURNITURE) -> Column:
    """True if a line holds an image, or something but markup that isn't page furniture (a pattern for whole lines)."""

    def line(x: Column) -> Column:
        bare = F.regexp_replace(x, MARKUP, "")
        return x.contains("![") | ((bare != "") & ~bare.rlike(f"^(?:{furniture})$"))

    return F.exists(F.split(text, "\n"), line)


def without_images(text: Column, bad: Column) -> Column:
    """The text without its image references to the paths of the list bad (with forward slashes); null drops none."""
    refs = F.regexp_extract_all(text, F.lit(IMAGE), F.lit(0))
    path = lambda ref: F.replace(F.regexp_extract(ref, r"\(([^)]*)\)$", 1), F.lit("\\"), F.lit("/"))
    gone = F.filter(refs, lambda ref: F.coalesce(F.array_contains(bad, path(ref)), F.lit(False)))
    return F.aggregate(gone, text, lambda t, ref: F.replace(t, ref, F.lit("")))
