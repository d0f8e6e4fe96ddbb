"""Connected components of links, by hooking to the smaller neighbour and contracting, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(keep: Scratch, links: DataFrame, name: str = "components") -> DataFrame:
    """node, root of every node of links (a, b): root is the smallest node of its component.

    Alternates the large-star and small-star steps of "Connected Components in MapReduce and Beyond" (2014): every node's larger neighbours are linked to its smallest neighbour; then every node's smaller
    neighbours are. Both are an aggregation with partial sums and a join; the number of rounds is about the logarithm of
    the longest chain. Only edges are moved, never a component as a whole. Each round's edges are a table of their own.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = keep.save(ordered(links), f"{name}-0")
    state, k = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first(), 0
    while True:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))  # one scan
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
        large = ordered(large)
        least = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.join(least, large["b"] == least["n"])
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        k += 1
        new = keep.save(ordered(small), f"{name}-{k}")
        keep.drop(f"{name}-{k - 1}")
        now = new.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        edges = new
        if tuple(now) == tuple(state):
            break
        state = now
    roots = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.union(edges.select("a", "a").distinct().toDF("node", "root"))
