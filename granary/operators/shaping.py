"""Shaping a ranked list: stitching parts of a page together, dropping repeats, quotas and budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import fingerprint

#: Words that the chunker repeats, the longest overlap looked for. More would trim text that repeats itself.
OVERLAP = 40


def stitch(a: str, b: str, most: int = OVERLAP) -> str:
    """a and b, without b's head where that repeats a's last words (two at least); b keeps its lines."""
    if not a.strip():
        return b or a
    if not b.strip():
        return a
    x, y = a.split(), b.split()
    for k in range(min(most, len(x), len(y)), 1, -1):
        if x[-k:] == y[:k]:
            rest, seen, inside = b, 0, False
            for i, c in enumerate(b):
                if c.isspace():
                    if inside and seen == k:
                        rest = b[i:].lstrip()
                        break
                    inside = False
                elif not inside:
                    inside, seen = True, seen + 1
            else:
                rest = ""
            return f"{a}\n{rest}" if rest else a
    return f"{a}\n{b}"


def runs(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds run: gaps and islands of chunk_part within keys, in the order of (chunk_part, rank). A part that doesn't
    follow its predecessor by one begins a run. Rows without part or total, or of one part, are runs of their own."""
    lone = F.col("chunk_part").isNull() | F.col("total_parts").isNull() | (F.col("total_parts") <= 1)
    order = W.partitionBy(*keys, "_lone").orderBy("chunk_part", "rank")
    hits = hits.withColumn("_lone", lone)
    follows = F.col("chunk_part") == F.lag("chunk_part").over(order) + 1
    hits = hits.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)) & ~F.col("_lone"), 0).otherwise(1))
    return hits.withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def stitch_parts(hits: DataFrame, keys: list[str], most: int = OVERLAP) -> DataFrame:
    """One row a run of neighbouring parts: keys, rank (the run's best), chunk_part (the lowest), content, stitched_parts
    (null if the run is one row), and all other columns as the lowest part has them. A run is at most the parts of one page."""
    others = [c for c in hits.columns if c not in (*keys, "rank", "chunk_part", "content", "stitched_parts")]

    @F.pandas_udf("string")
    def fold(lists: pd.Series) -> pd.Series:
        def one(texts: list[str]) -> str:
            out = texts[0]
            for t in texts[1:]:
                out = stitch(out, t, most)
            return out

        return lists.map(lambda x: one([t or "" for t in x]) if x is not None and len(x) else "")

    parts = F.array_sort(F.collect_list(F.struct("chunk_part", "rank", "content")))
    out = runs(hits, keys).groupBy(*keys, "_lone", "run").agg(F.min("rank").alias("rank"), F.min("chunk_part").alias("chunk_part"), parts.alias("_p"), F.count("*").alias("_n"), F.min_by(F.struct(F.lit(0).alias("_"), *others), F.struct("chunk_part", "rank")).alias("_m"))
    texts = F.when(F.col("_n") > 1, F.transform("_p", lambda p: p["content"]))  # the function is given all rows, so those of one part without their text
    content = F.when(F.col("_n") == 1, F.col("_p")[0]["content"]).otherwise(fold(texts))
    return out.select(*keys, "rank", "chunk_part", content.alias("content"), F.when(F.col("_n") > 1, F.col("_n").cast("int")).alias("stitched_parts"), *(F.col(f"_m.{c}") for c in others))


def distinct_texts(hits: DataFrame, by: list[str], order: list[Column | str], text: str = "content") -> DataFrame:
    """The first row, in this order, of each text (see fingerprint) within by."""
    w = W.partitionBy(*by, fingerprint(F.col(text))).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def shape(hits: DataFrame, bucket: Column, keep: int, per_doc: int, by: str = "query_id", text: str | None = "content") -> DataFrame:
    """The first `keep` rows of each query by rank, at most `per_doc` (one at least) of a bucket, texts once."""
    if keep < 1:
        return hits.limit(0)
    if text:
        hits = distinct_texts(hits, [by], ["rank"], text)
    quota = W.partitionBy(by, "_bucket").orderBy("rank")
    hits = hits.withColumn("_bucket", bucket).withColumn("_n", F.row_number().over(quota)).where(F.col("_n") <= max(1, per_doc))
    hits = hits.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("rank"))).where(F.col("_n") <= keep)
    return hits.drop("_bucket", "_n")


def budgets(top_k: int = 5, answer_context: int = 15, prefetch: int = 25, answering: bool = True) -> dict[str, int]:
    """How much each step reads so that what follows can fill its own limit."""
    fetch = max(top_k, answer_context) if answering else top_k
    deep = max(prefetch, 3 * fetch)
    return {"fetch": fetch, "rerank": 3 * fetch if answering else fetch, "prefetch": deep, "candidates": 6 * fetch, "hybrid_prefetch": max(4 * deep, 100)}
