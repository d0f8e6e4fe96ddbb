"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may be met with up to k word edits. Cut into k + 1 pieces, at least one piece of it then stands
unchanged in the document. Pieces are found by the hash of their first five words; where one hits, Myers' bit-parallel
algorithm gives the least edit distance of the item to any run of words near by.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, Words, chunks, column, fresh, text_column, utf8, windows

#: Words of a piece, at least; an item of n words has n // PIECE pieces, and its error budget is one less.
PIECE = 5
#: Items that one pass over the documents looks for; what goes to each task is bounded by that. More items, more passes.
ITEMS_A_PASS = 20_000


class Items(NamedTuple):
    ids: list
    words: list[np.ndarray]
    #: by piece, sorted by hash: hash of its first words, item, first word in the item
    hash: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    #: lengths of the pieces' hashed parts: PIECE, and less for items of fewer words
    sizes: list[int]
    size: np.ndarray
    mask: np.ndarray


MASK_BITS = 20


def budget(n: int) -> int:
    """Word edits allowed in an item of n words."""
    return max(0, n // PIECE - 1)


def prepare(ids: list, texts: list[str | None]) -> Items:
    words = []
    data, offsets = utf8(pa.array(texts, pa.string()))
    w = Words(data, offsets, PUNCT)
    rows = []
    for i in range(len(ids)):
        h = w.hash[w.first[i] : w.first[i + 1]]
        words.append(h.copy())
        n = len(h)
        pieces = budget(n) + 1
        for p in range(pieces if n else 0):
            start = p * n // pieces
            size = min(PIECE, n)
            rows.append((int(windows(h[start : start + size], np.array([0, size]), size)[0][0]), i, start, size))
    rows.sort()
    hash_, item, offset, size = (np.array([r[c] for r in rows], np.uint64 if c == 0 else np.int64) for c in range(4))
    mask = np.zeros(1 << MASK_BITS, bool)
    mask[(hash_ >> np.uint64(64 - MASK_BITS)).astype(np.int64)] = True
    return Items(ids, words, hash_, item, offset, sorted(set(size.tolist())), size, mask)


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the pattern to any run of the text, and where (after which word) the first such run ends.

    Columns of the distance matrix are kept as bit vectors of vertical differences, one machine or big integer each.
    """
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    peq: dict[int, int] = {}
    for i, x in enumerate(pattern.tolist()):
        peq[x] = peq.get(x, 0) | 1 << i
    up, down, score, best, at = full, 0, n, n, 0
    for j, x in enumerate(text.tolist()):
        eq = peq.get(x, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(flat | up) & full, up & flat
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full  # the run may start anywhere: no cost on the first row
        vertical = eq | down
        up, down = minus | ~(vertical | plus) & full, plus & vertical
        if score < best:
            best, at = score, j + 1
    return best, at


def find(items: Items, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, edits, first word of the region) for each document that holds an item within its budget."""
    w = Words(data, offsets, PUNCT)
    if not len(items.hash) or not len(w.hash):
        return
    doc_of = None
    tried: dict[tuple[int, int], list[int]] = {}
    for size in items.sizes:
        hashes, at, _ = windows(w.hash, w.first, size)
        near = np.flatnonzero(items.mask[(hashes >> np.uint64(64 - MASK_BITS)).astype(np.int64)])
        lo = np.searchsorted(items.hash, hashes[near], "left")
        hi = np.searchsorted(items.hash, hashes[near], "right")
        there = np.flatnonzero(hi > lo)
        if not len(there):
            continue
        if doc_of is None:
            doc_of = w.doc()
        for k in there.tolist():
            pos = int(at[near[k]])
            d = int(doc_of[pos])
            for p in range(int(lo[k]), int(hi[k])):
                if items.size[p] == size:
                    tried.setdefault((d, int(items.item[p])), []).append(pos - int(items.offset[p]))
    for (d, i), starts in sorted(tried.items()):
        pattern, best, done = items.words[i], None, None
        k = budget(len(pattern))
        for start in sorted(set(starts)):
            if done is not None and start <= done:
                continue  # this region was looked at with the one before
            lo, hi = max(int(w.first[d]), start - k), min(int(w.first[d + 1]), start + len(pattern) + 2 * k)
            done = start + k
            errors, _ = myers(pattern, w.hash[lo:hi])
            if errors <= k and (best is None or errors < best[0]):
                best = (errors, lo - int(w.first[d]))
                if errors == 0:
                    break
        if best is not None:
            yield d, i, best[0], best[1]


def passes(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of ITEMS_A_PASS, in the order of item_id."""
    n = benchmark.count()
    blocks = max(1, -(-n // ITEMS_A_PASS))
    for b in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.select("item_id", "text").collect()
        rows.sort(key=lambda r: (r[0] is None, r[0], r[1] or ""))
        yield prepare([r[0] for r in rows], [r[1] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, first_word: a row for each document and item that it holds with at most n // 5 - 1 word
    edits (n: the item's words; fewer than ten: no edit). Words are runs of letters and digits, A-Z in lower case.

    edits is the least of the document's regions in which a piece stands; first_word is where the first of the best
    regions begins. Null and empty texts match nothing, items without words neither; null ids pass through. Rows that
    repeat are answered each. Documents are looked at whole, in the task that reads them: nothing is shuffled.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, edits int, first_word long"
    out, item_type = None, benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    for items in passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                ids, (data, offsets) = column(batch, "doc_id"), utf8(column(batch, "text"))
                for lo, hi in chunks(offsets):
                    rows = list(find(items, data, offsets[lo : hi + 1]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([lo + r[0] for r in rows], pa.int64())),
                            pa.array([items.ids[r[1]] for r in rows], item_type),
                            pa.array([r[2] for r in rows], pa.int32()),
                            pa.array([r[3] for r in rows], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "edits", "first_word"],
                    )

        found = docs.select("doc_id", text_column().alias("text")).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold an item (see leaks). Rows are decided where they are read."""
    (text,) = fresh(docs, "_text")
    for items in passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(column(batch, text))
                stay = np.ones(batch.num_rows, bool)
                for lo, hi in chunks(offsets):
                    for d, *_ in find(shared.value, data, offsets[lo : hi + 1]):
                        stay[lo + d] = False
                yield batch.drop_columns([text]).filter(pa.array(stay))

        docs = docs.withColumn(text, text_column()).mapInArrow(run, docs.schema)
    return docs


