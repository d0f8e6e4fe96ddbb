"""Vector expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector the best dot product with one of the document's, summed."""
    best = lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))
    return F.aggregate(F.transform(query, best), F.lit(0.0), lambda s, x: s + x)
