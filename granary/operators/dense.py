"""Dense retrieval: exact cosine top-k in blocks, and late-interaction re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.sizes import if_small
from granary.jobs.scratch import saved

from .sparse import ranked

#: Queries that go to all tasks at once, if their vectors have BYTES at most; more go in blocks of as many, which meet blocks of vectors in a grid.
QUERIES, VECTORS = 32_768, 32_768
#: Bytes of the vectors of a block, and of queries' token vectors that go to all tasks, as doubles.
BYTES = 64 << 20
#: Queries and vectors whose scores a task holds at once.
QUERY_STEP, VECTOR_STEP = 256, 4096


def _blocks(rows: DataFrame, components: Column, most: int) -> int:
    """How many blocks of `most` rows, and of BYTES, the rows make; one at least."""
    n, numbers = rows.agg(F.count("*"), F.sum(components.cast("long"))).first()
    return max(1, -(-n // most), -(-8 * (numbers or 0) // BYTES))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 25, id_: str = "vec_id", most: int = QUERIES) -> DataFrame:
    """query_id, id, score, rank of the k nearest by cosine. vectors: id, embedding; queries: query_id, embedding.

    A task scores rows against a block of queries by matrix products of QUERY_STEP times VECTOR_STEP scores and passes on k rows for each
    query and block of vectors. It holds both blocks and one step's scores, whatever the table's size. Queries of one block go to
    the vectors, and only the found rows are shuffled; with more, the vectors are moved once for each block of
    queries. Vectors that are null, or null or not finite in a component, take no part.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & finite).select(id_, "embedding")
    asked = queries.where(F.col("embedding").isNotNull() & finite).select("query_id", "embedding")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {id_} {dict(vectors.dtypes)[id_]}, score double"
    blocks = _blocks(asked, F.size("embedding"), most)
    if blocks == 1:
        shared = vectors.sparkSession.sparkContext.broadcast(asked.toArrow())

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= VECTORS or 2 * sum(b.nbytes for b in held) >= BYTES:
                    yield from _best(shared.value, pa.Table.from_batches(held), k, id_).to_batches()
                    held = []
            if held:
                yield from _best(shared.value, pa.Table.from_batches(held), k, id_).to_batches()

        return ranked(rows.mapInArrow(best, schema), k, id_)
    parts = _blocks(rows, F.size("embedding"), VECTORS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    left = asked.select("query_id", "embedding", place("query_id", blocks).alias("q"), every(parts).alias("v"))
    right = rows.select(id_, "embedding", place(id_, parts).alias("v"), every(blocks).alias("q"))

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        return _best(q, v, k, id_)

    return ranked(left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(meet, schema), k, id_)


#: A score of six decimals and a vector's place as one number, which a double holds: greater for a greater score, then for a place before. They are
#: not negative, and less than 2 ** 53.
_SCALE, _PLACES = 1_000_000, 1 << 31


def _best(queries: pa.Table, vectors: pa.Table, k: int, id_: str) -> pa.Table:
    """The k best of these vectors (id, embedding) for each query (query_id, embedding); ties to the smaller id.

    Scores are held for a step of vectors and of queries; of the step those pass on that reach a query's k-th best so far."""
    names, vectors = queries["query_id"].combine_chunks(), vectors.sort_by(id_)
    q, best = _units(queries["embedding"]), np.full((len(queries), min(k, len(vectors))), -1.0)
    for at in range(0, len(vectors), VECTOR_STEP) if best.size else ():
        v = _units(vectors["embedding"].slice(at, VECTOR_STEP)).T
        for lo in range(0, len(q), QUERY_STEP):
            _meet(best[lo : lo + QUERY_STEP], q[lo : lo + QUERY_STEP] @ v, at)
    there, key = best >= 0, best[best >= 0].astype(np.int64)
    return pa.table({"query_id": names.take(pa.array(np.nonzero(there)[0])), id_: vectors[id_].take(pa.array(_PLACES - 1 - key % _PLACES)), "score": pa.array((key // _PLACES - _SCALE) / _SCALE)})


def _meet(best: np.ndarray, scores: np.ndarray, at: int) -> None:
    """Takes a step's scores (query, vector from place `at` on) into the keys of each query's best, the greatest first; -1 where there are fewer."""
    least = np.floor(best[:, -1] / _PLACES) - _SCALE - 1  # below the k-th, so that rounding loses none
    row, place = np.nonzero(scores >= (least / _SCALE)[:, None])
    if not len(row):
        return
    key = (np.rint(scores[row, place] * _SCALE) + _SCALE) * _PLACES + (_PLACES - 1 - at - place)
    first = np.searchsorted(row, np.arange(len(best) + 1))
    wide, k = np.full((len(best), best.shape[1] + int(np.diff(first).max())), -1.0), best.shape[1]
    wide[:, :k] = best
    wide[row, k + np.arange(len(row)) - first[row]] = key
    best[:] = np.sort(np.partition(wide, wide.shape[1] - k, axis=1)[:, -k:], axis=1)[:, ::-1]


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors, all of one length, as rows of length 1; zeros stay."""
    out = column.combine_chunks()
    if isinstance(out, pa.ChunkedArray):
        out = out.chunk(0) if out.num_chunks else pa.array([], out.type)
    m = out.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(out), -1) if len(out) else np.zeros((0, 1))
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def rerank(pool: DataFrame, documents: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id", most: int = QUERIES) -> DataFrame:
    """query_id, id, score, rank: the k best of each query's pool (query_id, id) by late interaction. documents: id, tokens (vectors);
    queries: query_id, tokens. For each of a query's vectors the best product with one of the document's counts; documents
    and queries without vectors, or with components that are null or not finite, take no part.

    Of the documents only the pool's have their vectors read past the join, and a document's vectors are moved once, with the queries that
    ask for it. Up to `most` queries' vectors, of BYTES at most, go to all tasks; more are joined to the pool. Vectors are multiplied in Arrow batches.
    """
    finite = F.coalesce(F.size("tokens") > 0, F.lit(False)) & F.forall("tokens", lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))
    doubles = F.transform("tokens", lambda v: F.transform(v, lambda x: x.cast("double")))
    # floats are moved as they are, and made doubles where they are multiplied
    own = lambda df, name: df.where(finite).select(name, "tokens" if dict(df.dtypes)["tokens"] == "array<array<float>>" else doubles.alias("tokens"))
    queries, documents = own(queries, "query_id"), own(documents, id_)
    asked = saved(pool.sparkSession, pool.select("query_id", id_).distinct())  # not searched again for its size
    few = _blocks(queries, F.aggregate("tokens", F.lit(0), lambda n, v: n + F.size(v)), most) == 1
    if few:
        local = queries.toArrow()
        by_id = asked.groupBy(id_).agg(F.collect_list("query_id").alias("asked"))  # `most` at most
        rows = documents.join(if_small(by_id), id_)
    else:
        rows = documents.join(if_small(asked), id_).join(queries.withColumnRenamed("tokens", "q_tokens"), "query_id")
        rows = rows.select(F.array("query_id").alias("asked"), id_, "tokens", "q_tokens")
    shared = pool.sparkSession.sparkContext.broadcast(dict(zip(local["query_id"].to_pylist(), _matrices(local["tokens"]), strict=True)) if few else None)
    schema = f"query_id {dict(pool.dtypes)['query_id']}, {id_} {dict(documents.dtypes)[id_]}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            names, at, scores = [], [], []
            aside = None if few else _matrices(of("q_tokens"))
            for i, (who, document) in enumerate(zip(of("asked").to_pylist(), _matrices(of("tokens")), strict=True)):
                for name in who:
                    q = shared.value.get(name) if few else aside[i]
                    if q is not None:
                        names.append(name)
                        at.append(i)
                        scores.append(float((q @ document.T).max(axis=1).sum()))
            kind = of("asked").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), of(id_).take(pa.array(at, pa.int64())), pa.array(np.round(np.array(scores, float), 6))], names=["query_id", id_, "score"])

    return ranked(rows.mapInArrow(run, schema), k, id_)


def _matrices(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's list of equally long vectors as a matrix."""
    out = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(out, pa.ChunkedArray):
        out = out.chunk(0) if out.num_chunks else pa.array([], out.type)
    sizes = np.diff(out.offsets.to_numpy()) if len(out) else np.zeros(0, np.int64)
    vectors = out.flatten()
    lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    values, rows, parts = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(lengths)])
    return [values[parts[a] : parts[b]].reshape(b - a, -1) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
