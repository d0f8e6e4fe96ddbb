"""Near-duplicate documents by order MinHash (Marcais et al., "Locality-sensitive hashing for the edit distance", 2019).

A document's k-mers are its runs of five words, each labelled by how often it occurred before. Each of several sketches
takes the document's two smallest labelled k-mers under a hash of its own and keeps them in the order of the text. Equal
sketches make candidates. A candidate pair is a link if a banded alignment of the two k-mer sequences matches at least
0.8 of them: matched / (matched + unmatched of both), so that order counts and moved text does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, Scratch, Words, chunks, column, fresh, mix, partitions, signed, text_column, utf8, windows
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
#: At the threshold a pair shares one sketch with probability 0.8 ** 2 at least, so of twelve none with 0.36 ** 12 = 5e-6.
SKETCHES = 12
#: K-mers up to which an alignment may hold a mask of all places for each k-mer; they take the square of it in bits at most.
_WHOLE = 1 << 14
#: Parity bits a k-mer, and the least and most of a text.
BITS, LEAST_BITS, MOST_BITS = 4, 256, 1 << 16
#: Nodes and k-mers of a bucket's part; a task compares two parts with each other at once.
CELL, CELL_KMERS = 2048, 2_000_000
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' k-mers in text order, and each document's first. Words: A-Z in lower case, punctuation cut."""
    w = Words(data, offsets, PUNCT)
    hashes, _, first = windows(w.hash, w.first, SHINGLE)
    return hashes, first


def labelled(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The k-mers' hashes, changed for the second and later occurrences in a document by their number."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    key = hashes ^ mix(doc, 3)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    if new.all():
        return hashes
    at = np.arange(len(key))
    number = np.empty(len(key), np.int64)
    number[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(number > 0, mix(hashes + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 5), hashes)


def sketches(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document with k-mers, by number, SKETCHES hashes of two ordered k-mers (of one, if there is but one)."""
    counts = np.diff(first)
    docs = np.flatnonzero(counts)
    out = np.zeros((len(docs), SKETCHES), np.uint64)
    if not len(docs):
        return docs, out
    start, counts = first[:-1][docs], counts[docs]
    own = np.repeat(np.arange(len(docs)), counts)
    names = labelled(hashes, first)
    two = counts > 1
    for s in range(SKETCHES):
        v = mix(names, 100 + s)

        def least() -> np.ndarray:
            low = np.minimum.reduceat(v, start)  # noqa: B023
            at = np.flatnonzero(v == low[own])  # noqa: B023
            place = np.empty(len(docs), np.int64)
            place[own[at[::-1]]] = at[::-1]
            return place

        a = least()
        v[a[two]] = _FAR
        b = np.where(two, least(), a)
        early, late = np.minimum(a, b), np.maximum(a, b)
        pair = mix(names[early], 1) + mix(names[late], 2) * np.uint64(0x9E3779B97F4A7C15)
        out[:, s] = mix(np.where(two, pair, mix(names[a], 4)), 1000 + s)
    return docs, out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Share of k-mers that the best alignment in order matches: m / (len(a) + len(b) - m), or 0.0 where it is under the
    threshold. m is the longest common subsequence within the band that a pair over the threshold can't leave: so many
    k-mers may stay unmatched on either side. Bit-parallel: a row of the band is one integer."""
    na, nb = len(a), len(b)
    if not na or not nb:
        return 0.0
    need = threshold * (na + nb) / (1 + threshold)  # matches that the threshold asks for
    if min(na, nb) < need - 1e-9:
        return 0.0
    if na == nb and np.array_equal(a, b):
        return 1.0
    n = min(na, nb)
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[na - n + head :][::-1] != b[nb - n + head :][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    x, y, m = a[head : na - tail], b[head : nb - tail], head + tail
    if len(x) and len(y):
        if m + len(np.intersect1d(x, y)) + min(len(x) - len(np.unique(x)), len(y) - len(np.unique(y))) < need - 1e-9:
            return 0.0
        band = int(min(na, nb) - need + 1e-9) + abs(na - nb) + 1
        m += _common(x.tolist(), y.tolist(), band)
    share = m / (na + nb - m)
    return share if share >= threshold - 1e-12 else 0.0


def _common(x: list[int], y: list[int], band: int) -> int:
    """Longest common subsequence among places (i, j) with |i - j| <= band. Bits of `row` are the places i of x whose
    column rises there are cleared; the window of bits in the band moves with j, bits left of it are settled."""
    where: dict[int, list[int]] = {}
    for i, v in enumerate(x):
        where.setdefault(v, []).append(i)
    n = len(x)
    whole = n <= min(4 * band + 256, _WHOLE)
    masks = {v: sum(1 << i for i in at) if len(at) < 4 else _bits(at) for v, at in where.items()} if whole else None
    if masks is not None:  # the band is most of the table: whole rows
        full = (1 << n) - 1
        row = full
        for v in y:
            hit = masks.get(v)
            if hit:
                u = row & hit
                row = (row + u | row - u) & full
        return n - row.bit_count()
    # window: bit k stands for place base + k
    width, base, settled = 2 * band + 1, 0, 0
    row, full = (1 << width) - 1, (1 << width) - 1
    for j, v in enumerate(y):
        move = min(j - band, n) - base
        if move > 0:
            settled += move - (row & (1 << move) - 1).bit_count()
            row = row >> move | ((1 << move) - 1) << (width - move)
            base += move
        at = where.get(v)
        if at:
            hit = 0
            for i in at if len(at) < 8 else at[_left(at, base) : _left(at, base + width)]:
                if 0 <= i - base < width:
                    hit |= 1 << (i - base)
            if hit:
                u = row & hit
                row = (row + u | row - u) & full
    top = max(0, min(width, n - base))
    return settled + top - (row & (1 << top) - 1).bit_count()


def _left(at: list[int], value: int) -> int:
    lo, hi = 0, len(at)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if at[mid] < value else (lo, mid)
    return lo


def _bits(at: list[int]) -> int:
    raw = bytearray(at[-1] // 8 + 1)
    for i in at:
        raw[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(raw, "little")


def _sketched(rows: DataFrame) -> DataFrame:
    """node, first (smallest doc_id), size (k-mers) and marks (its sketches; null without k-mers) of each different text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            for lo, hi in chunks(offsets):
                hashes, first = kmers(data, offsets[lo : hi + 1])
                docs, marks = sketches(hashes, first)
                some = np.zeros(hi - lo, np.int64)
                some[docs] = SKETCHES
                starts = pa.array(np.concatenate([[0], np.cumsum(some)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(starts, pa.array(signed(marks.ravel())), mask=pa.array(some == 0))
                own = [column(batch, c).slice(lo, hi - lo) for c in ("node", "doc_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first).astype(np.int64)), lists], names=["node", "doc_id", "size", "marks"])

    kind = dict(rows.dtypes)["doc_id"]
    each = rows.select("node", "doc_id", "text").mapInArrow(run, f"node binary, doc_id {kind}, size long, marks array<long>")
    return each.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("marks").alias("marks"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts align at the threshold."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_x")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("_y")), "b").select("a", "b", "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = utf8(column(batch, "_x")), utf8(column(batch, "_y"))
            good = np.zeros(batch.num_rows, bool)
            for lo, hi in chunks(x[1] + y[1]):
                (hx, fx), (hy, fy) = kmers(x[0], x[1][lo : hi + 1]), kmers(y[0], y[1][lo : hi + 1])
                for i in range(hi - lo):
                    good[lo + i] = aligned(hx[fx[i] : fx[i + 1]], hy[fy[i] : fy[i + 1]], threshold) > 0
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a binary, b binary")


def _close(one: str, other: str, threshold: float) -> Column:
    """Whether texts of so many k-mers can align at the threshold: the shorter has that share of the longer at least."""
    return F.least(one, other) >= F.greatest(one, other) * threshold - 1e-6


def _star(shared: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of each node with the heaviest node of each of its buckets, but for pairs whose sizes alone keep them
    under the threshold. shared: bucket, node, size, n (nodes of the bucket); a node weighs as much as it shares buckets
    with others. Rows grow with the bucket, not with its square."""
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    lead = shared.join(weights, "node").groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "node", "size")).alias("_lead"))
    both = shared.join(lead, "bucket").select(F.col("_lead.node").alias("a"), F.col("_lead.size").alias("before"), F.col("node").alias("b"), "size")
    both = both.where((F.col("a") != F.col("b")) & _close("before", "size", threshold))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def parities(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each document's parity bits: whether an odd number of its labelled k-mers falls in a cell.

    The bits in which two documents differ are at most as many as the k-mers that only one of them has. There are at
    least BITS cells a k-mer (up to MOST_BITS), a power of two; XORing its halves makes a row of half the cells."""
    out, names = [], mix(labelled(hashes, first), 9)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        cells = min(MOST_BITS, max(LEAST_BITS, 1 << int(BITS * (hi - lo) - 1).bit_length())) if hi > lo else LEAST_BITS
        odd = np.bincount((names[lo:hi] & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, the bits in which two tables of bytes differ; the wider table's rows are folded to the other's width."""
    if left.shape[1] < right.shape[1]:
        left, right = right, left
    width = right.shape[1]
    folded = np.bitwise_xor.reduce(left.reshape(len(left), -1, width), axis=1) if left.shape[1] > width else left
    return np.bitwise_count((folded ^ right).view(np.uint64)).sum(1, dtype=np.int64)


class _Parities:
    """Rows of a binary column by their width."""

    def __init__(self, values: pa.Array):
        offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
        data = np.frombuffer(values.buffers()[2], np.uint8)
        self.width = np.diff(offsets)
        self.place = np.zeros(len(values), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = data[offsets[at][:, None] + np.arange(w)]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        both = self.width[i] * (1 << 20) + self.width[j]
        for key in np.unique(both).tolist():
            at, (v, w) = np.flatnonzero(both == key), divmod(key, 1 << 20)
            step = max(1, (1 << 24) // max(v, w))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                out[part] = differing(self.rows[v][self.place[i[part]]], self.rows[w][self.place[j[part]]])
        return out


_CELL = ["bucket", "band", "x", "y"]


def _flat(table: pa.Table, name: str) -> pa.Array:
    values = table[name].combine_chunks()
    return values.chunk(0) if isinstance(values, pa.ChunkedArray) else values


def _near(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i, j of whole cells that may align, and how many k-mers they differ in at least. Left out: rows of one root, pairs
    that sizes or parities rule out, and pairs that share an earlier sketch, which another bucket compares."""
    key = np.stack([t[c].to_numpy() for c in _CELL], 1)
    roots = np.unique(np.array(_flat(t, "root").to_pylist(), object), return_inverse=True)[1]
    marks = _flat(t, "marks").flatten().to_numpy().reshape(-1, SKETCHES)
    part, mine, size = t["part"].to_numpy(), t["mine"].to_numpy(), t["size"].to_numpy()
    bits, n, slack = _Parities(_flat(t, "parity")), len(t), (1 - threshold) / (1 + threshold)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    start = np.flatnonzero(new)
    end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    after = end - np.arange(n) - 1
    total = np.cumsum(after)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 18), "right")))
        i = np.repeat(np.arange(at, to), after[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[at:to]) - after[at:to], after[at:to])
        at = to
        good = (mine[i] | mine[j]) & (roots[i] != roots[j]) & ((part[i] != part[j]) | (key[i, 2] == key[i, 3]))
        good &= np.minimum(size[i], size[j]) >= np.maximum(size[i], size[j]) * threshold - 1e-6
        i, j = i[good], j[good]
        earliest = (marks[i] == marks[j]).argmax(1)
        here = marks[i, earliest] == key[i, 0]
        i, j = i[here], j[here]
        apart = bits.apart(i, j)
        near = apart <= (size[i] + size[j]) * slack + 1e-6
        if near.any():
            yield i[near], j[near], apart[near]


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted batches, put together and cut so that no cell is in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([column(batch, c).to_numpy() for c in _CELL], 1)
        turns = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        before = np.array([column(held[-1], c)[-1].as_py() for c in _CELL]) if held else key[0]
        cut = int(turns[-1]) if len(turns) else 0
        if cut or (before != key[0]).any():
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cells(rows: DataFrame, threshold: float, most: int) -> DataFrame:
    """Deals the nodes of each bucket (bucket, node, root, size) to cells (bucket, band, x, y) so that each two nodes of a bucket
    that have different roots, and sizes in reach of the threshold, meet in one cell.

    Nodes meet by bands of size, each with its own and the next: so wide are the bands that no pair is further apart. In a bucket's
    band, the nodes of its most frequent root have nothing to look for among themselves: they and the others are dealt in parts,
    and each part of the others is a cell with every part. So n nodes, m of them with other roots, give n * (1 + m / most) +
    m * (1 + n / most) rows at most, and no task holds all of a bucket.
    """
    wide = float(np.log(1 / threshold)) * 1.001 if threshold < 1 else 1e-9
    band = F.floor(F.log(F.col("size").cast("double")) / wide).cast("long")
    rows = rows.withColumn("own", band).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("band", F.col("own") - F.col("step")).withColumn("mine", F.col("step") == 0)
    by_root = rows.groupBy("bucket", "band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.max("mine").alias("any"))
    many = by_root.groupBy("bucket", "band").agg(
        F.sum("n").alias("n"), F.sum("all").alias("all"), F.max("any").alias("any"), F.count("*").alias("roots"), F.max(F.struct("n", "root", "all")).alias("top")
    )
    parts = lambda n, size: F.greatest(F.ceil(n / most), F.ceil(size / CELL_KMERS)).cast("int")
    top = F.col("top")
    many = many.where("any AND roots > 1").select(
        "bucket", "band", top.root.alias("top"), parts(top.n, top.all).alias("first"), parts(F.col("n") - top.n, F.col("all") - top.all).alias("rest")
    )
    dealt, h = rows.join(many, ["bucket", "band"]), F.xxhash64("node")
    main = F.col("root") == F.col("top")
    dealt = dealt.withColumn("part", F.when(main, F.pmod(h, "first")).otherwise(F.col("first") + F.pmod(h, "rest")).cast("int"))
    last = F.col("first") + F.col("rest") - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(main, F.col("first")).otherwise(0), last)))
    return dealt.select("bucket", "band", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "mine", "node", "root", "size")


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *_CELL).sortWithinPartitions(*_CELL)


def _others(keep: Scratch, rows: DataFrame, bodies: DataFrame, threshold: float, most: int = CELL) -> DataFrame:
    """Links (a, b) that join all roots of rows (bucket, node, root, size) which belong together: of the nodes that share a
    bucket and have different roots, each two that align are in one class by these links and the roots.

    First each cell keeps the nodes that may align with another of it, by sizes and parities; then these meet again with
    their texts (bodies: node, text, marks), the nearest first, and pairs that are in one class by now are passed over. So
    a cell gives as many links at most as it has nodes.
    """
    dealt = keep.save(_cells(rows, threshold, most), "cells")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            for lo, hi in chunks(offsets):
                values = pa.array(parities(*kmers(data, offsets[lo : hi + 1])), pa.binary())
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(lo, hi - lo) for c in ("node", "marks")), values], names=["node", "marks", "parity"])

    wanted = bodies.join(dealt.select("node").distinct(), "node", "left_semi")
    known = wanted.select("node", "marks", "text").mapInArrow(bits, "node binary, marks array<long>, parity binary")
    names = [*_CELL, "part", "mine", "node", "root", "size", "marks", "parity"]
    full = dealt.join(known, "node").select(names)

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            some = np.zeros(len(t), bool)
            for i, j, _ in _near(t, threshold):
                some[i] = some[j] = True
            if some.any():
                yield from t.filter(pa.array(some)).to_batches()

    left = keep.save(_by_cell(full).mapInArrow(may, full.schema), "may")
    keep.drop("cells")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[bytes, bytes] = {}

        def top(r: bytes) -> bytes:
            while r in above:
                above[r] = r = above.get(above[r], above[r])
            return r

        for t in _whole_cells(batches):
            data, offsets = utf8(_flat(t, "text"))
            words = [h[f[k] : f[k + 1]] for lo, hi in chunks(offsets) for h, f in [kmers(data, offsets[lo : hi + 1])] for k in range(hi - lo)]
            node, root, found = _flat(t, "node"), _flat(t, "root").to_pylist(), []
            for i, j, apart in _near(t, threshold):
                for at in np.argsort(apart, kind="stable").tolist():
                    a, b = int(i[at]), int(j[at])
                    one, other = top(root[a]), top(root[b])
                    if one != other and aligned(words[a], words[b], threshold) > 0:
                        above[one] = other
                        found.append((a, b))
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([node.take(pa.array(at[:, 0])), node.take(pa.array(at[:, 1]))], names=["a", "b"])

    whole = _by_cell(left.join(bodies.select("node", "text"), "node").select(*names, "text"))
    found = keep.save(whole.mapInArrow(links, "a binary, b binary"), "links-others")
    keep.drop("may")
    return found


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node (digest of a text), root (the digest that stands for its class), first (smallest doc_id of that text), and class_id (smallest
    doc_id of the class) for each different text of docs that has words.

    Equal texts are one node. Within a bucket, nodes are first compared with the bucket's heaviest, the one that shares
    most buckets with others, which of an original and its copies is the original; components of these links are
    contracted. Then all pairs of nodes that share a bucket and are still apart are compared (_others), so in the end each
    two nodes of a bucket are in one class or don't align.
    """
    keep = Scratch(docs.sparkSession)
    # nothing is known of a text without words, so it is like no other
    rows = docs.select("doc_id", text_column().alias("text")).withColumn("node", F.unhex(F.md5("text")))
    nodes = keep.save(_sketched(rows), "nodes")
    each = nodes.select(F.explode("marks").alias("bucket"), "node", "size")
    full = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep.save(each.join(full, "bucket"), "shared")
    # of equal texts, however many, only the one with the smallest id goes on: the join is dealt by node and id
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.xxhash64("first").alias("id"), "marks")
    once = rows.select("node", F.xxhash64("doc_id").alias("id"), "text").join(wanted, ["node", "id"])
    bodies = keep.save(once.groupBy("node", "id").agg(F.first("text").alias("text"), F.first("marks").alias("marks")).drop("id"), "bodies")
    pairs = keep.save(_star(shared, threshold), "pairs")
    links = keep.save(_verified(pairs, bodies, threshold), "links")
    keep.drop("pairs")
    roots = keep.save(components(keep, links), "roots")
    apart = shared.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"), "size")
    more = _others(keep, apart, bodies, threshold)
    keep.drop("shared", "bodies")
    if not more.isEmpty():
        roots = keep.save(components(keep, links.union(more), "components-others"), "roots-others")
    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = keep.save(named, "named")
    keep.drop("nodes", "roots")
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    return named.join(least, "root").select("node", "root", "first", "class_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, kept (class_id is this row's doc_id) for each row of docs.

    class_id is the smallest doc_id of the documents joined by links, equal texts included, in one step or several. Texts
    without words (null, empty, punctuation alone) have the class of their equals only if they are not blank; null and
    blank texts are each their own. A text of one to four words has one k-mer, all of it. Rows that repeat a doc_id are
    documents of their own if their texts differ. Classes whose doc_ids are all null have a null class_id.
    """
    named = classes(docs, threshold).select(F.col("node").alias("_node"), "class_id")
    text = text_column()
    rows = docs.select("doc_id", F.when(F.trim(text) != "", F.unhex(F.md5(text))).alias("_key"))
    out = rows.join(named, F.col("_key") == F.col("_node"), "left")
    out = out.select("doc_id", F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
    return out.withColumn("kept", F.col("class_id").eqNullSafe(F.col("doc_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, one for each class of near duplicates (see near_duplicates): the row with the smallest doc_id.
    Null and blank texts all stay. Rows equal in doc_id and text are copies too; one of them stays."""
    named = classes(docs, threshold)
    key, node, mine, theirs = fresh(docs, "_key", "_node", "_mine", "_theirs")
    # of each class, the text whose first row has the smallest id; ties (ids that repeat, or are null) go by digest
    chosen = named.where(F.col("first").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("node", "first")).alias("m"))
    chosen = chosen.select(F.col("m.node").alias(node), F.col("m.first").alias(theirs))
    chosen = Scratch(docs.sparkSession).save(chosen, "chosen")  # joined twice
    text = text_column()
    rows = docs.withColumn(key, F.when(F.trim(text) != "", F.unhex(F.md5(text))))
    stay = rows.join(chosen, (F.col(key) == F.col(node)) & F.col("doc_id").eqNullSafe(F.col(theirs)), "left_semi")
    repeated = stay.groupBy(key).count().where("count > 1")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates([key])
    return stay.union(rows.where(F.col(key).isNull())).select(docs.columns)

