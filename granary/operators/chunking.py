"""Chunks of pages: prose windows by expressions, and the chunker that keeps table rows whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import BREAK, FURNITURE, MARKUP, words

MAX_WORDS, OVERLAP, MAX_TOKENS, MIN_WORDS = 300, 40, 420, 150


def prose_windows(docs: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, id_: str = "doc_id") -> DataFrame:
    """id, chunk_part (from 1), total_parts, text: the words, if they are at most max_words, else windows of max_words words
    that start every max_words - overlap. The last window may lie in the one before; stitching takes it out again."""
    step = max(1, max_words - overlap)
    rows = docs.select(id_, words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.when(F.size("w") > max_words, F.size("w") - 1).otherwise(0)
    rows = rows.select(id_, "w", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("i", "start"))
    return rows.select(
        id_,
        (F.col("i") + 1).alias("chunk_part"),
        F.when(F.size("w") > max_words, F.ceil(F.size("w") / F.lit(step))).otherwise(1).cast("int").alias("total_parts"),
        F.array_join(F.slice("w", F.col("start") + 1, max_words), " ").alias("text"),
    )


class Unit(NamedTuple):
    kind: str  # row, prose, head, image; window for a part of long prose
    body: str
    header: str
    clause: str


class Chunk(NamedTuple):
    text: str
    block_kind: str
    clause: str


_NUMBER = re.compile(r"\d+(?:\.\d+)+")
_RULE = re.compile(r"\s*\|[\s:|-]+")
_STARTS = (("row", re.compile(r"\s*\|")), ("blank", re.compile(r"\s*$")), ("head", re.compile(r"\s*#")), ("image", re.compile(r"\s*!\[.*?\]\(.*?\)\s*$")))
_FURNITURE, _MARKUP, _BREAK = re.compile(FURNITURE), re.compile(MARKUP), re.compile(BREAK, re.I)


def _tokens(text: str) -> int:
    return len(text.split()) + text.count("|") + 2 * len(_BREAK.findall(text))


def _signal(text: str) -> bool:
    bare = (_MARKUP.sub("", line) for line in text.splitlines())
    return "![" in text or any(x and not _FURNITURE.fullmatch(x) for x in bare)


def _kind(line: str) -> str:
    return next((k for k, start in _STARTS if start.match(line)), "prose")


def _first_cell(row: str) -> str:
    return row.strip().strip("|").split("|")[0].strip()


def _table(lines: list[str]) -> Iterator[tuple[str, str]]:
    """Rows and their headers: a rule line makes a header of the row before it, for all rows up to the next rule line."""
    header, rules = "", [bool(_RULE.fullmatch(x)) for x in lines] + [False]
    for i, line in enumerate(lines):
        if rules[i]:
            header = line if not i or rules[i - 1] else f"{lines[i - 1]}\n{line}"
        elif not rules[i + 1]:
            yield line, header


def units(page: str) -> Iterator[Unit]:
    """Parts of a page that aren't cut, in order. The clause is the number in the last heading that has one, or the first cell
    of a header or row that holds a clause number alone."""
    clause = ""
    for kind, run in groupby(page.splitlines(), _kind):
        if kind == "row":
            for row, header in _table(list(run)):
                clause = next((c for c in map(_first_cell, (row, header.split("\n")[0])) if _NUMBER.fullmatch(c)), clause)
                yield Unit(kind, row, header, clause)
        elif kind == "prose":
            yield Unit(kind, "\n".join(run), "", clause)
        elif kind != "blank":
            for line in run:
                if kind == "head" and (number := _NUMBER.search(line)):
                    clause = number[0]
                yield Unit(kind, line, "", clause)


def chunk_page(page: str, max_words: int = MAX_WORDS, overlap: int = OVERLAP, max_tokens: int = MAX_TOKENS, min_words: int = MIN_WORDS) -> list[Chunk]:
    """Chunks of a page: units are gathered while they fit; no table row is cut, and each chunk with rows has their header.

    Prose that doesn't fit by itself becomes word windows. A table unit of another clause closes a chunk that holds
    table units and min_words words. Chunks without a signal are dropped, windows never. An oversize row stands whole.
    A chunk's clause is that of its first table unit, or else of its first unit."""
    groups: list[list[tuple[str, Unit]]] = [[]]

    def text(group: list[tuple[str, Unit]], *more: str) -> str:
        return "\n".join([*(piece for piece, _ in group), *more])

    def small(t: str) -> bool:
        return len(t.split()) <= max_words and _tokens(t) <= max_tokens

    for u in units(page):
        if u.kind != "row" and not small(u.body):
            w = u.body.split()
            groups += [[(" ".join(w[i : i + max_words]), u._replace(kind="window"))] for i in range(0, len(w), max(1, max_words - overlap))]
            groups.append([])
            continue
        here = groups[-1]
        whole = f"{u.header}\n{u.body}" if u.header else u.body
        piece = u.body if u.header in text(here) else whole
        rows = [x.clause for _, x in here if x.kind == u.kind == "row"]
        turns = rows and rows[-1] != u.clause and len(text(here).split()) >= min_words
        if turns or here and not small(text(here, piece)):
            groups.append([(whole, u)])
        else:
            here.append((piece, u))
    out = []
    for group in groups:
        if group and (group[0][1].kind == "window" or _signal(text(group))):
            clauses = [u.clause for _, u in group if u.kind == "row"]
            out.append(Chunk(text(group), "table" if clauses else "prose", (clauses or [group[0][1].clause])[0]))
    return out


def chunk_pages(pages: DataFrame, id_: str = "doc_id", **limits: int) -> DataFrame:
    """id, chunk_part, total_parts, text, block_kind, clause of the pages (id, text); a page is one row's work."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, text in zip(f[id_], f["text"], strict=True):
                parts = chunk_page(text or "", **limits)
                rows += [(key, i + 1, len(parts), *c) for i, c in enumerate(parts)]
            yield pd.DataFrame(rows, columns=[id_, "chunk_part", "total_parts", "text", "block_kind", "clause"])

    kind = dict(pages.dtypes)[id_]
    return pages.select(id_, "text").mapInPandas(run, f"{id_} {kind}, chunk_part int, total_parts int, text string, block_kind string, clause string")
