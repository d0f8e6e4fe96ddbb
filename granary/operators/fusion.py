"""Reciprocal rank fusion, and the hybrid of dense and sparse retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.postings import Postings

from . import dense, sparse
from .maintenance import search_filter
from .sparse import ranked


def rrf(*lists: DataFrame, k: int, constant: int = 60, id_: str = "doc_id") -> DataFrame:
    """query_id, id, score, rank: scores are sums over the lists (query_id, id, rank from 1) of 1 / (constant + rank);
    60 is the constant of Cormack et al. 2009. A union and one aggregation; the order of the lists doesn't matter."""
    every = reduce(DataFrame.unionByName, (x.select("query_id", id_, "rank") for x in lists))
    return ranked(every.groupBy("query_id", id_).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score")), k, id_)


def hybrid(docs: DataFrame, queries: DataFrame, k: int, prefetch: int, current_only: bool = True, diagrams_only: bool = False, id_: str = "doc_id", stored: Postings | None = None) -> DataFrame:
    """query_id, id, score, rank: the best by terms and the best by vectors, `prefetch` of each, fused. docs: id, text, embedding
    (null: found by terms only), is_current, has_diagram; queries: query_id, text, embedding.

    The filter stands before both searches, so it is applied where the documents are read, and no rank is spent on a
    document that may not be returned; document frequencies are those of the documents left. With the documents' stored postings
    (by is_current and has_diagram) no text is read.
    """
    wanted = search_filter(current_only, diagrams_only)
    may, asked = docs.where(wanted), queries.select("query_id", "text")
    terms = stored.search(asked, prefetch, wanted) if stored else sparse.search(may.select(id_, "text"), asked, prefetch, id_)
    near = dense.top_k(may.select(id_, "embedding"), queries.select("query_id", "embedding"), prefetch, id_)
    return rrf(terms, near, k=k, id_=id_)


def late(docs: DataFrame, queries: DataFrame, k: int, prefetch: int, current_only: bool = True, diagrams_only: bool = False, id_: str = "doc_id") -> DataFrame:
    """query_id, id, score, rank: of the `prefetch` documents nearest by their vectors, the k best by late interaction. docs: id, embedding,
    tokens (the document's token vectors), is_current, has_diagram; queries: query_id, embedding, tokens. The filter stands before both
    levels; a document without token vectors is left out after the first."""
    may = docs.where(search_filter(current_only, diagrams_only))
    pool = dense.top_k(may.select(id_, "embedding"), queries.select("query_id", "embedding"), prefetch, id_)
    return dense.rerank(pool, may.select(id_, "tokens"), queries.select("query_id", "tokens"), k, id_)
