"""Similarity graph of documents, from centroids and from the chunks' nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.vectors import cosine
from granary.jobs.scratch import saved

#: Rows of a block of chunks that meets others in the pairwise step; directions that bound the angles between blocks' vectors.
BLOCK, PIVOTS = 1024, 4


def centroids(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, n, centroid: the mean of each component; sums meet in an aggregation with partial sums."""
    each = chunks.select(doc, F.posexplode("embedding").alias("pos", "x"))
    means = each.groupBy(doc, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(doc).agg(F.max("n").alias("n"), F.transform(ordered, lambda s: s["m"]).alias("centroid"))


def centroid_edges(centers: DataFrame, threshold: float, doc: str = "doc_id") -> DataFrame:
    """a < b, weight: pairs of documents whose centroids' cosine reaches the threshold. One row a document, not a chunk; only those are
    compared that the angles to fixed directions allow (close_documents), which meet by equal joins."""
    centers = saved(centers.sparkSession, centers.select(doc, "centroid"))
    placed = _blocks(centers.select(doc, F.lit(0).cast("long").alias("_n"), F.col("centroid").alias("embedding")), doc, "_n")
    pairs = close_documents(placed, threshold, doc).join(centers.select(F.col(doc).alias("a"), F.col("centroid").alias("x")), "a")
    pairs = pairs.join(centers.select(F.col(doc).alias("b"), F.col("centroid").alias("y")), "b")
    return pairs.select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("weight")).where(F.col("weight") >= threshold)


def _blocks(chunks: DataFrame, doc: str, id_: str) -> DataFrame:
    """doc, id, unit (the vector, of length 1), angles (to PIVOTS fixed directions), block: the chunks in the order of documents, cut into
    blocks of at most BLOCK. Vectors that are null, empty or not finite take no part. Written once; read by all later steps."""
    kinds = dict(chunks.dtypes)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = chunks.where((F.size("embedding") > 0) & finite).select(doc, id_, F.transform("embedding", lambda x: x.cast("double")).alias("unit"))
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            m = _matrix(batch.column(2))
            m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
            pivots = np.random.default_rng(PIVOTS).normal(size=(PIVOTS, m.shape[1]))
            angles = np.arccos(np.clip(m @ (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).T, -1, 1))
            lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            block = pa.array(base + (at + np.arange(len(m))) // BLOCK)
            at += len(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(m), lists(angles), block], names=[doc, id_, "unit", "angles", "block"])

    ordered = rows.repartitionByRange(n, doc, id_).sortWithinPartitions(doc, id_)
    return saved(chunks.sparkSession, ordered.mapInArrow(run, f"{doc} {kinds[doc]}, {id_} {kinds[id_]}, unit array<double>, angles array<double>, block long"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    out = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = out.chunk(0) if isinstance(out, pa.ChunkedArray) else out
    return out.flatten().to_numpy(zero_copy_only=False).reshape(len(out), -1) if len(out) else np.zeros((0, 1))


def close_documents(blocks: DataFrame, threshold: float, doc: str) -> DataFrame:
    """a < b: the documents that may have two chunks whose cosine reaches the threshold. The angle of two vectors is at least the difference
    of their angles to any pivot, so documents whose ranges of angles lie too far apart have none. Ranges meet by bands of
    one pivot's angle, in an equal join; the other pivots are looked at for pairs that meet."""
    ranges = [f(F.col("angles")[i]).alias(f"{name}{i}") for i in range(PIVOTS) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    ends = blocks.groupBy(doc).agg(*ranges)
    reach = float(np.arccos(max(-1.0, min(1.0, threshold)))) + 1e-6
    band = lambda x: F.floor(x / max(reach, 0.02)).cast("int")
    a = ends.select("*", F.explode(F.sequence(band(F.col("lo0")), band(F.col("hi0")))).alias("_band")).withColumnsRenamed({doc: "a", **{f"{x}{i}": f"a_{x}{i}" for i in range(PIVOTS) for x in ("lo", "hi")}})
    b = ends.select("*", F.explode(F.sequence(band(F.col("lo0") - reach), band(F.col("hi0") + reach))).alias("_band")).withColumnRenamed(doc, "b")
    near = [F.greatest(F.col(f"lo{i}") - F.col(f"a_hi{i}"), F.col(f"a_lo{i}") - F.col(f"hi{i}")) <= reach for i in range(PIVOTS)]
    return a.join(b, "_band").where((F.col("a") < F.col("b")) & reduce(Column.__and__, near)).select("a", "b").distinct()


def block_pairs(blocks: DataFrame, close: DataFrame, doc: str) -> DataFrame:
    """i <= j: the blocks that hold chunks of close documents a and b. Blocks follow the documents' order, so a's never comes after b's."""
    parts = blocks.select(doc, "block").distinct()
    left = close.join(parts.select(F.col(doc).alias("a"), F.col("block").alias("i")), "a")
    return left.join(parts.select(F.col(doc).alias("b"), F.col("block").alias("j")), "b").select("i", "j").distinct()


def chunk_edges(chunks: DataFrame, top: int, threshold: float, doc: str = "doc_id", id_: str = "vec_id") -> DataFrame:
    """a < b, weight: for each chunk of document a the `top` best cosines among b's chunks, their mean over all of a, where it reaches
    the threshold.

    Not symmetric: a is the smaller document. Documents that can't reach the threshold are left out beforehand (close_documents), and
    only blocks that hold chunks of others meet, each pair once: a task multiplies two blocks and passes on `top` rows for each
    chunk and other document, so neither a document nor a block pair grows with the data.
    """
    kinds = dict(chunks.dtypes)
    spark = chunks.sparkSession
    blocks = _blocks(chunks, doc, id_)
    close = saved(spark, close_documents(blocks, threshold, doc))
    pairs = saved(spark, block_pairs(blocks, close, doc))
    left = blocks.select(doc, id_, "unit", F.col("block").alias("i")).join(pairs, "i")
    right = blocks.select(F.col(doc).alias("_doc"), F.col("unit").alias("_unit"), F.col("block").alias("j")).join(pairs.select(F.col("i").alias("_i"), F.col("j").alias("_j")), F.col("j") == F.col("_j"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        scores, a, b = _matrix(x["unit"]) @ _matrix(y["_unit"]).T, x[doc].to_numpy(), y["_doc"].to_numpy()
        for other in np.unique(b):
            mine = np.flatnonzero(a < other)
            if len(mine):
                s = -np.sort(-scores[np.ix_(mine, b == other)], axis=1)[:, :top]
                out.append((np.repeat(mine, s.shape[1]), np.full(s.size, np.flatnonzero(b == other)[0]), s.ravel()))
        at, to, s = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        at, to = pa.array(at), pa.array(to)
        return pa.table({"a": x[doc].take(at), "b": y["_doc"].take(to), "chunk": x[id_].take(at), "s": pa.array(s)})

    found = left.groupBy("i", "j").cogroup(right.groupBy("_i", "_j")).applyInArrow(meet, f"a {kinds[doc]}, b {kinds[doc]}, chunk {kinds[id_]}, s double")
    w = W.partitionBy("a", "b", "chunk").orderBy(F.desc("s"))
    best = found.join(close, ["a", "b"], "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    return best.groupBy("a", "b").agg(F.round(F.avg("s"), 6).alias("weight")).where(F.col("weight") >= threshold)


def merge_edges(one: DataFrame, other: DataFrame) -> DataFrame:
    """a, b, weight: the mean where both estimates passed their threshold, else the one that did."""
    x, y = one.withColumnRenamed("weight", "x"), other.withColumnRenamed("weight", "y")
    mean = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), (F.col("x") + F.col("y")) / 2).otherwise(F.coalesce("x", "y"))
    return x.join(y, ["a", "b"], "full").select("a", "b", F.round(mean, 6).alias("weight"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree: how many edges end at each; 0 for nodes without any."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
