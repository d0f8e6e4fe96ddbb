"""Sparse retrieval: postings, document frequencies, and TF-IDF scores of queries against all documents."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.sizes import if_small
from granary.functions.text import lowered, token_id, tokens

#: Terms (query and token) that tasks hold at once; beyond that, queries and documents meet by a shuffled join.
TERMS = 200_000
#: Documents and queries of a block that is scored at once, and bytes of text that are cut into tokens at once.
BLOCK, QUERY_BLOCK, TEXT_BYTES = 512, 256, 1 << 22
#: Tokens of a block's documents that are multiplied at once.
TOKEN_BLOCK = 4096


def postings(docs: DataFrame, id_: str = "doc_id", text: str = "text", key: str = "token_id") -> DataFrame:
    """id, token_id, token (one of those with the id), tf: a row for each document and token, or token id. Ids have 31
    bits, so in a large vocabulary some tokens share one; key="token" keeps them apart."""
    each = docs.select(id_, F.explode(tokens(F.col(text))).alias("token"))
    if key == "token":
        return each.groupBy(id_, "token").agg(F.count("*").alias("tf")).select(id_, token_id(F.col("token")).alias("token_id"), "token", "tf")
    return each.groupBy(id_, token_id(F.col("token")).alias("token_id")).agg(F.min("token").alias("token"), F.count("*").alias("tf"))


def document_frequency(posted: DataFrame, key: str = "token_id") -> DataFrame:
    if key == "token":
        return posted.groupBy("token").agg(F.count("*").alias("df"))
    return posted.groupBy("token_id").agg(F.min("token").alias("token"), F.count("*").alias("df"))


def idf(df: Column, documents: int) -> Column:
    """ln(1 + (N - n + 0.5) / (n + 0.5)), as BM25 weighs terms (Robertson and Zaragoza 2009)."""
    return F.log(1 + (F.lit(documents) - df + 0.5) / (df + 0.5))


def ranked(scored: DataFrame, k: int, id_: str = "doc_id") -> DataFrame:
    """The k best rows of each query, with rank from 1; ties to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), id_)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 25, id_: str = "doc_id", terms: int = TERMS) -> DataFrame:
    """query_id, id, score, rank. queries: query_id, text. Scores are rounded to six decimals before they are ranked.

    Up to `terms` terms of queries go to all tasks, which score the documents that they read and pass on the k best of each
    batch; nothing of the corpus is shuffled. More meet the documents' tokens in joins.
    """
    asked = postings(queries, "query_id").select("query_id", "token_id", F.col("tf").alias("q_tf"))
    local = asked.limit(terms + 1).toArrow()
    return _by_blocks(docs, local, k, id_, dict(queries.dtypes)["query_id"]) if local.num_rows <= terms else _by_joins(docs, asked, k, id_)


def _by_joins(docs: DataFrame, asked: DataFrame, k: int, id_: str) -> DataFrame:
    """Documents meet the queries' tokens before anything is shuffled, so only matching postings move; document frequencies
    come from those, too."""
    wanted = if_small(asked.select("token_id").distinct())
    each = docs.select(id_, F.explode(tokens(F.col("text"))).alias("token")).select(id_, token_id(F.col("token")).alias("token_id"))
    matched = each.join(wanted, "token_id").groupBy(id_, "token_id").agg(F.count("*").alias("tf"))
    weights = matched.groupBy("token_id").agg(F.count("*").alias("df")).select("token_id", idf(F.col("df"), docs.count()).alias("idf"))
    scored = matched.join(asked.join(weights, "token_id"), "token_id").groupBy("query_id", id_)
    return ranked(scored.agg(F.round(F.sum(F.col("q_tf") * F.col("tf") * F.col("idf")), 6).alias("score")), k, id_)


class Terms(NamedTuple):
    """What the queries ask for: the tokens' ids in order; and for each term its query, its token's place in them, and its weight."""

    wanted: np.ndarray
    query: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    queries: pa.Array


def _crc_table() -> np.ndarray:
    """The remainders of CRC-32 by byte."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, np.uint32(0xEDB88320) ^ (r >> np.uint32(1)), r >> np.uint32(1)).astype(np.uint32)
    return r


_TABLE = _crc_table()


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts (lower-case), lo to hi: each token's document (from lo) and id."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TEXT_BYTES, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        first = offsets[lo : hi + 1] - offsets[lo]
        inside = np.zeros(len(part) + 1, bool)
        inside[:-1] = (part >= 97) & (part <= 122) | (part >= 48) & (part <= 57)
        edge = np.zeros(len(part) + 1, bool)
        edge[first] = True
        before = np.concatenate([[False], inside[:-1]])
        start = np.flatnonzero(inside & (~before | edge))
        end = np.flatnonzero(before & (~inside | edge))
        crc, at, left = np.full(len(start), 0xFFFFFFFF, np.uint32), start.copy(), np.arange(len(start))
        while len(left):
            crc[left] = _TABLE[(crc[left] ^ part[at[left]]) & 0xFF] ^ (crc[left] >> np.uint32(8))
            at[left] += 1
            left = left[at[left] < end[left]]
        yield lo, hi, np.searchsorted(first, start, "right") - 1, (~crc & np.uint32(0x7FFFFFFF)).astype(np.int64)
        lo = hi


def token_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts (lower-case), from lo on: document (from lo), token id and count of each token id of a document."""
    for lo, _, doc, ids in _tokens(texts):
        pairs, n = np.unique(doc << 31 | ids, return_counts=True)
        yield lo, pairs >> 31, pairs & 0x7FFFFFFF, n


def counts(texts: pa.Array, wanted: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts (lower-case), lo to hi: document (from lo), place in wanted (sorted token ids) and count of each token of
    a document that is wanted."""
    for lo, hi, doc, ids in _tokens(texts):
        place = np.minimum(np.searchsorted(wanted, ids), max(0, len(wanted) - 1))
        hit = wanted[place] == ids if len(wanted) else np.zeros(len(ids), bool)
        pairs, n = np.unique(doc[hit] * max(1, len(wanted)) + place[hit], return_counts=True)
        yield lo, hi, pairs // max(1, len(wanted)), pairs % max(1, len(wanted)), n


def _by_blocks(docs: DataFrame, asked: pa.Table, k: int, id_: str, query_kind: str) -> DataFrame:
    """Two passes over the documents: document frequencies of the wanted tokens, then scores."""
    names = asked["query_id"].combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    queries, query = names.dictionary, names.indices.to_numpy().astype(np.int64)
    wanted, place = np.unique(asked["token_id"].to_numpy().astype(np.int64), return_inverse=True)
    lower, spark = docs.select(id_, lowered(F.col("text")).alias("text")), docs.sparkSession
    to_tasks = spark.sparkContext.broadcast(wanted)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(to_tasks.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, _, places, _ in counts(batch.column(0), to_tasks.value):
                df += np.bincount(places, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["place", "df"])

    found = lower.select("text").mapInArrow(frequencies, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    df = dict(zip(found["place"].to_pylist(), found["df"].to_pylist(), strict=True))
    n = df.pop(-1, 0)
    many = np.array([df.get(i, 0) for i in range(len(wanted))], float)
    weight = asked["q_tf"].to_numpy() * np.log(1 + (n - many + 0.5) / (many + 0.5))[place]
    shared = spark.sparkContext.broadcast(Terms(wanted, query, place, weight, queries))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_))
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            turn = np.empty(len(order), np.int64)
            turn[order] = np.arange(len(order))
            rows = [(lo + d, p, c) for lo, _, d, p, c in counts(batch.column(batch.schema.get_field_index("text")), t.wanted)]
            doc, token, tf = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(3))
            for q in range(0, len(t.queries), QUERY_BLOCK):
                yield from _best_of(t, q, doc, token, tf, turn, ids, batch.num_rows, k)

    def _best_of(t, q, doc, token, tf, turn, ids, n, k) -> Iterator[pa.RecordBatch]:
        mine = (t.query >= q) & (t.query < q + QUERY_BLOCK)
        used, column = np.unique(t.place[mine], return_inverse=True)
        weights = np.zeros((len(used), min(QUERY_BLOCK, len(t.queries) - q)))
        weights[column, t.query[mine] - q] = t.weight[mine]
        at = np.searchsorted(used, token)
        hit = used[np.minimum(at, len(used) - 1)] == token
        d, at, f = doc[hit], at[hit], tf[hit]
        scores = np.zeros((n, weights.shape[1]))
        for lo in range(0, n, BLOCK):
            a, b = np.searchsorted(d, [lo, lo + BLOCK])
            for col in range(0, len(used), TOKEN_BLOCK):  # long queries have many tokens
                some = (at[a:b] >= col) & (at[a:b] < col + TOKEN_BLOCK)
                block = np.zeros((min(BLOCK, n - lo), min(TOKEN_BLOCK, len(used) - col)))
                block[d[a:b][some] - lo, at[a:b][some] - col] = f[a:b][some]
                scores[lo : lo + BLOCK] += block @ weights[col : col + TOKEN_BLOCK]
        scores, chosen = np.round(scores, 6), []
        for i in range(weights.shape[1]):
            s = scores[:, i]
            there = np.flatnonzero(s > 0)
            if len(there) > k:
                there = there[s[there] >= np.partition(s[there], len(there) - k)[len(there) - k]]
            chosen.append(there[np.lexsort((turn[there], -s[there]))][:k])
        of, at = np.repeat(np.arange(len(chosen)), [len(x) for x in chosen]), np.concatenate(chosen)
        yield pa.RecordBatch.from_arrays([t.queries.take(pa.array(q + of)), ids.take(pa.array(at)), pa.array(scores[at, of])], names=["query_id", id_, "score"])

    kind = dict(docs.dtypes)[id_]
    return ranked(lower.mapInArrow(best, f"query_id {query_kind}, {id_} {kind}, score double"), k, id_)
