"""Functions for SQL: after register(spark), queries chunk pages laterally and find cites by name.

    SELECT p.doc_id, c.* FROM pages p, LATERAL chunk_page(p.text) c
    SELECT p.doc_id, c.* FROM pages p, LATERAL chunk_page(p.text, max_words => 120) c
    SELECT answer_id, cite_spans(answer, array('Field Handbook')).pages FROM answers
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from granary.operators.audit import SPANS, cites_of
from granary.operators.chunking import chunk_page

_LIMITS = ("max_words", "overlap", "max_tokens", "min_words")


class ChunkPage:
    """Table function: chunk_part, total_parts, text, block_kind, clause of a page's text. Limits are given by name; a null text is empty."""

    @staticmethod
    def analyze(text: AnalyzeArgument, **limits: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, (StringType, NullType)):
            raise ValueError(f"chunk_page takes a text, not {text.dataType.simpleString()}")
        for name, given in limits.items():
            if name not in _LIMITS:
                raise ValueError(f"chunk_page has no limit {name}; it has {', '.join(_LIMITS)}")
            if not isinstance(given.dataType, IntegerType) or not given.isConstantExpression:
                raise ValueError(f"{name} must be a constant integer")
        out = StructType()  # no session here that could read type names
        for name, kind in (("chunk_part", IntegerType()), ("total_parts", IntegerType()), ("text", StringType()), ("block_kind", StringType()), ("clause", StringType())):
            out = out.add(name, kind)
        return AnalyzeResult(out)

    def eval(self, text: str | None, **limits: int) -> Iterator[tuple]:
        parts = chunk_page(text or "", **limits)
        for i, c in enumerate(parts):
            yield i + 1, len(parts), c.text, c.block_kind, c.clause


def register(spark: SparkSession) -> None:
    """Names chunk_page and cite_spans in the session."""
    spark.udtf.register("chunk_page", F.udtf(ChunkPage))

    @F.pandas_udf(SPANS)
    def cite_spans(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [cites_of(t or "", [n for n in (x if x is not None else []) if n]) for t, x in zip(texts, names, strict=True)]
        return pd.DataFrame(rows, columns=["codes", "editions", "pages"])

    spark.udf.register("cite_spans", cite_spans)
