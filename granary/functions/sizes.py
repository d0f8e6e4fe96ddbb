"""Checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes as JSON, of a side that a join may send to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows and bytes; a larger side is shuffled like the other. One look at
    the first rows tells both."""
    n, bytes_ = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count("*"), F.sum("b")).first()
    return F.broadcast(df) if n <= rows and (bytes_ or 0) <= size else df
