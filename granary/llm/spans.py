"""Substring dedup by sliding sentence spans.

A document is cut into sentences (ends: . ! or ? before white space, and line ends; a sentence of over 20 words is cut
where its words say so: before the word with the least hash of each twelve in a row). So pieces of long sentences are twelve
words at most, and 48 words that two long sentences share are cut alike from their twelfth word on, wherever they begin. Spans are runs of at least three consecutive sentences that hold at least twelve words: the shortest such run
from each sentence on, and the shortest up to each. Their hashes meet globally. The first document of a span keeps it; all
sentences that a span covers anywhere else are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, Words, chunks, column, fresh, mix, signed, text_column, utf8

SENTENCES, SPAN_WORDS, CUT = 3, 12, 20
#: Words in a row of which the one with the least hash (of equal ones the last) begins a piece, in sentences over CUT.
WINDOW = 12
_B = np.uint64(0x9E3779B97F4A7C15)


class Spans:
    """Sentences and spans of some documents. Sentence s: words word[s] to word[s+1]; span: sentences lo to hi (inclusive)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = self.words = Words(data, offsets, SPACES)
        n = len(w.hash)
        self.docs = len(offsets) - 1
        begins = np.zeros(n + 1, bool)
        begins[w.first[:-1]] = True
        if n:
            last = w.bytes[w.end - 1]
            closes = (last == 0x2E) | (last == 0x21) | (last == 0x3F)
            lines = np.cumsum(w.bytes == 0x0A)
            closes[:-1] |= lines[w.start[1:]] > lines[w.end[:-1] - 1]
            begins[1:] |= closes
        at = np.flatnonzero(begins[:n])
        length = np.diff(np.append(at, n))
        # long sentences are cut by content, so that equal passages are cut alike wherever they begin
        begins[self._cuts(at, length)] = True
        self.word = np.append(np.flatnonzero(begins[:n]), n)
        self.first = np.searchsorted(self.word[:-1], w.first)
        self.doc = np.repeat(np.arange(self.docs), np.diff(self.first))
        self._spans()

    def _cuts(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words that begin a piece of a sentence over CUT: at and length are of all sentences."""
        long = length > CUT
        windows = length[long] - WINDOW + 1
        i = np.arange(int(windows.sum())) + np.repeat(at[long] - (np.cumsum(windows) - windows), windows)
        key = mix(self.words.hash, 11)
        best, least = i, key[i]
        for k in range(1, WINDOW):
            new = key[i + k]
            take = new <= least
            best, least = np.where(take, i + k, best), np.where(take, new, least)
        return np.unique(best)

    def _spans(self) -> None:
        s = len(self.word) - 1
        start, end = self.first[self.doc], self.first[self.doc + 1]
        i = np.arange(s)
        hi = np.maximum(i + SENTENCES, np.searchsorted(self.word, self.word[:-1] + SPAN_WORDS, "left"))
        ok = hi <= end
        lo = np.minimum(i + 1 - SENTENCES, np.searchsorted(self.word, self.word[1:] - SPAN_WORDS, "right") - 1)
        ok_lo = lo >= start
        a = np.concatenate([i[ok], lo[ok_lo]])
        b = np.concatenate([hi[ok], i[ok_lo] + 1])
        once = np.unique(a * (s + 1) + b)
        self.lo, self.hi = (once // (s + 1)), once % (s + 1)
        first, last = self.word[self.lo], self.word[self.hi]
        # hash of a run of words, from sums that hold for any run: sum of h[j] * B^(j - first)
        h, n = self.words.hash, len(self.words.hash)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = _B
        np.cumprod(powers, out=powers)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers[:n], out=sums[1:])
        back = np.ones(n + 1, np.uint64)
        back[1:] = np.uint64(pow(int(_B), -1, 1 << 64))
        np.cumprod(back, out=back)
        self.hash = mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.of = self.doc[self.lo] if s else np.zeros(0, np.int64)
        # the same span again in one document
        order = np.lexsort((self.lo, self.hash, self.of))
        same = np.zeros(len(order), bool)
        same[1:] = (self.hash[order][1:] == self.hash[order][:-1]) & (self.of[order][1:] == self.of[order][:-1])
        self.again = np.zeros(len(order), bool)
        self.again[order] = same

    def covered(self, spans: np.ndarray) -> np.ndarray:
        """Sentences that the chosen spans cover."""
        edge = np.zeros(len(self.word), np.int64)
        np.add.at(edge, self.lo[spans], 1)
        np.add.at(edge, self.hi[spans], -1)
        return np.cumsum(edge)[:-1] > 0

    def text(self, doc: int, gone: np.ndarray) -> bytes:
        """The document without these sentences: each goes with the white space up to the next."""
        w, (a, b) = self.words, self.first[doc : doc + 2]
        cut = np.append(w.start[self.word[a:b]], self.ends[doc])
        head = w.bytes[self.starts[doc] : cut[0]].tobytes()
        kept = [w.bytes[cut[j] : cut[j + 1]].tobytes() for j in range(b - a) if not gone[a + j]]
        return head + b"".join(kept) if len(kept) == b - a else (head + b"".join(kept)).rstrip()


def _emit(docs: DataFrame, own: list[str], text: str) -> DataFrame:
    """hash, and the columns `own` that tell documents apart: a row for each document and each of its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = [column(batch, c) for c in own], utf8(column(batch, text))
            for lo, hi in chunks(offsets):
                s = Spans(data, offsets[lo : hi + 1])
                new = ~s.again
                of = pa.array(lo + s.of[new])
                yield pa.RecordBatch.from_arrays([pa.array(signed(s.hash[new])), *(x.take(of) for x in ids)], names=["hash", *own])

    return docs.select(*own, text).mapInArrow(run, ", ".join(["hash long", *(f"{c} {dict(docs.dtypes)[c]}" for c in own)]))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text cut down, and n_sentences and n_removed (sentences of the text before, and those removed).

    First is the document with the smallest doc_id; within a document, a span's first place. Null and empty texts stay as
    they are; texts with fewer than three sentences or twelve words have no spans. Null ids come last; of rows with one id, the
    one whose text has the smaller hash comes first, and rows equal in id and text are one document: they all keep what it
    keeps. A column n_chars, if there is one, is made to fit the new text. Columns n_sentences, n_removed are replaced.

    Equal spans are counted by an aggregation with partial sums, so a span that a third of all documents hold is no
    burden; the join back to its documents is one that Spark can split.
    """
    docs = docs.drop("n_sentences", "n_removed")
    doc, id_, text, theirs, spans = fresh(docs, "_doc", "_id", "_text", "_of", "_spans")
    ids = docs.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1))
    rows = docs.withColumn(text, text_column())
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint") and ids.isEmpty():
        # the id alone tells documents apart: one number a span is shuffled
        rows, own, order = rows.withColumn(doc, F.col("doc_id").cast("long")), [doc], F.col(doc)
    else:
        rows, own = rows.withColumns({doc: F.xxhash64("doc_id", "text"), id_: F.col("doc_id")}), [doc, id_]
        order = F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(doc).alias("doc"))
    keep = Scratch(docs.sparkSession)
    first = _emit(rows, own, text).groupBy("hash").agg(F.min(order).alias("_first"), F.max(order).alias("_last")).where("_first <> _last")
    first = keep.save(first.select("hash", "_first"), "repeated")
    later = _emit(rows, own, text).join(first, "hash").where(order != F.col("_first"))
    later = later.groupBy(F.col(doc).alias(theirs)).agg(F.collect_set("hash").alias(spans))
    marked = rows.join(keep.save(later, "later"), F.col(doc) == F.col(theirs), "left").drop(doc, id_, theirs)
    schema = docs.withColumns({"n_sentences": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(column(batch, text))
            lists, total, removed, new = column(batch, spans), [], [], {}
            for lo, hi in chunks(offsets):
                s = Spans(data, offsets[lo : hi + 1])
                s.starts, s.ends = offsets[lo:hi] - offsets[lo], offsets[lo + 1 : hi + 1] - offsets[lo]
                chosen = s.again.copy()
                some = lists.slice(lo, hi - lo)
                there = np.flatnonzero(some.is_valid().to_numpy(zero_copy_only=False))
                if len(there):
                    flat = some.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                    of = np.repeat(there, pc.list_value_length(some).drop_null().to_numpy())
                    wanted = np.unique(mix(flat) ^ mix(of.astype(np.uint64), 7))
                    chosen |= np.isin(mix(s.hash) ^ mix(s.of.astype(np.uint64), 7), wanted)
                gone = s.covered(chosen)
                total.append(np.diff(s.first))
                removed.append(np.bincount(s.doc[gone], minlength=s.docs))
                for d in np.flatnonzero(removed[-1]).tolist():
                    new[lo + d] = s.text(d, gone).decode()
            out = column(batch, "text")
            if new:
                where = np.zeros(batch.num_rows, bool)
                where[list(new)] = True
                out = pc.replace_with_mask(out, pa.array(where), pa.array([new[d] for d in sorted(new)], out.type))
            cols = {c: column(batch, c) for c in names}
            cols["text"] = out
            if "n_chars" in cols and new:
                n = pc.utf8_length(out).cast(cols["n_chars"].type)
                cols["n_chars"] = pc.if_else(pa.array(where), n, cols["n_chars"])
            flat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*cols.values(), flat(total), flat(removed)], names=[*names, "n_sentences", "n_removed"])

    return marked.mapInArrow(run, schema)
