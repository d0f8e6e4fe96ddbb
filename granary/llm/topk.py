"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights. Queries go in blocks against blocks of candidates; within a block, each
component's postings (candidate, weight) are scattered, weighted, into the queries' dense score arrays, the k best are
selected by partition, and the blocks' bests are merged for each query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block; a task holds one block of queries and one of candidates. All pairs of blocks meet, so queries times candidates /
#: QUERY_ROWS + queries times candidates / CANDIDATE_ROWS rows are moved.
CANDIDATE_ROWS, QUERY_ROWS = 16_384, 8_192
#: Queries and candidates whose scores are held at once: an array that stays in a core's cache.
QUERY_STEP, CANDIDATE_STEP = 16, 4_096


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, as a long (held at the ends of its range)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def finite(vector: Column) -> Column:
    """False for null vectors and for null, NaN and infinite components."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, ok), F.lit(False))


class Postings:
    """Of some candidates, for each component the candidates that have it (not zero), in order, and its weights."""

    def __init__(self, candidates: list[np.ndarray]):
        lengths = np.fromiter(map(len, candidates), np.int64, len(candidates))
        self.n, self.dim = len(candidates), int(lengths.max(initial=0))
        terms = np.concatenate([np.arange(x) for x in lengths]) if self.n else np.zeros(0, np.int64)
        weights = np.concatenate(candidates).astype(np.int64) if self.n else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(self.n), lengths)
        used = weights != 0
        terms, weights, rows = terms[used], weights[used], rows[used]
        order = np.argsort(terms, kind="stable")
        self.bounds = np.searchsorted(terms[order], np.arange(self.dim + 1))
        self.rows, self.weights = rows[order], weights[order]
        #: A component that a quarter of the candidates have is written out, with zeros.
        self.whole: dict[int, np.ndarray] = {}
        for t in np.flatnonzero(4 * np.diff(self.bounds) >= max(1, self.n)).tolist():
            at = slice(self.bounds[t], self.bounds[t + 1])
            self.whole[t] = np.zeros(self.n, np.int64)
            self.whole[t][self.rows[at]] = self.weights[at]

    def add(self, queries: np.ndarray, scores: np.ndarray) -> None:
        """Adds to scores (query, candidate), for each component that a query has, its weight times that component's postings.
        queries: weights (query, component)."""
        product = np.empty_like(scores)
        for t in range(self.dim):
            some, lo, hi = np.flatnonzero(queries[:, t]), self.bounds[t], self.bounds[t + 1]
            if not len(some) or lo == hi:
                continue
            if t in self.whole:
                np.multiply(queries[:, t, None], self.whole[t], out=product)
                scores += product
            else:
                scores[np.ix_(some, self.rows[lo:hi])] += queries[some, t, None] * self.weights[lo:hi]


def best_of_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best candidates of this block; ties to the smaller id, as often as the id is there. The postings are built once,
    for steps of candidates; all queries are then scored against them, a few at a time."""
    candidates = candidates.sort_values("vec_id", kind="stable")
    ids, vectors = candidates["vec_id"].to_numpy(np.int64), list(candidates["vector"])
    steps = [(lo, Postings(vectors[lo : lo + CANDIDATE_STEP])) for lo in range(0, len(vectors), CANDIDATE_STEP)]
    dim = max((p.dim for _, p in steps), default=0)
    owns, whole = queries["vec_id"].to_numpy(np.int64), list(queries["vector"])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(queries), QUERY_STEP):
        own, part = owns[lo : lo + QUERY_STEP], whole[lo : lo + QUERY_STEP]
        weights = np.zeros((len(own), dim), np.int64)
        for i, q in enumerate(part):
            weights[i, : min(dim, len(q))] = q[:dim]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
        for at, p in steps:
            scores = np.zeros((len(own), p.n), np.int64)
            p.add(weights, scores)
            for i, s in enumerate(scores):
                there = np.flatnonzero(ids[at : at + p.n] != own[i]) if own[i] in ids[at : at + p.n] else None
                s = s if there is None else s[there]
                place = _best(s, k)
                kept = np.concatenate([best[i][1], s[place]]), np.concatenate([best[i][0], at + (place if there is None else there[place])])
                first = _best(kept[0], k)  # places stay in order, so ties go to the smaller id
                best[i] = kept[1][first], kept[0][first]
        found += [(np.full(len(place), own[i]), ids[place], s) for i, (place, s) in enumerate(best)]
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Places, in order, of the k greatest; of equals the first."""
    if len(s) <= k:
        return np.arange(len(s))
    least = np.partition(s, len(s) - k)[len(s) - k]
    above = np.flatnonzero(s > least)
    return np.sort(np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]]))


def top_k(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score of the k best candidates of each query, ties to the smaller vec_id.

    vectors: vec_id, embedding. queries: a condition on its rows; several query rows of one vec_id are one query (the
    greatest vector of them). Candidates: all rows of another vec_id; rows that repeat a vec_id stay several candidates.
    Null ids and vectors that are null or hold null or non-finite components take no part; shorter vectors count as if
    ended by zeros. With fewer than k candidates, all are returned. Scores beyond 64 bits wrap around.

    Rows are dealt to blocks evenly whatever the data, so no key can be hot; each query block goes to every candidate
    block. Both counts follow the table's size, so a task's memory does not.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("vector"), queries.alias("_query")
    )
    n, asked = rows.agg(F.count("*"), F.count_if("_query")).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-asked // QUERY_ROWS))
    c_blocks = max(c_blocks, min(-(-n // 256), 24))  # small tables are shared out too
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    c = rows.select("vec_id", "vector", (F.monotonically_increasing_id() % c_blocks).cast("int").alias("c"), every(q_blocks).alias("q"))
    q = rows.where("_query").groupBy("vec_id").agg(F.max("vector").alias("vector"))
    q = q.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q"), every(c_blocks).alias("c"))
    found = (
        q.groupBy("c", "q")
        .cogroup(c.groupBy("c", "q"))
        .applyInPandas(lambda a, b: best_of_block(a, b, k), "query_id long, vec_id long, score long")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(every: int = 50, k: int = 5) -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"""
