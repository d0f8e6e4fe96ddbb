"""Evaluation on golden questions: evidence, first hits and recall."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.sizes import if_small
from granary.functions.text import tokens


#: Keywords that tasks hold at once; keywords by document name that a task remembers to have told.
KEYWORDS, TOLD = 100_000, 1_000_000


def any_keyword(text: Column, keywords: Column) -> Column:
    lower = F.lower(text)
    return F.exists(keywords, lambda k: F.contains(lower, F.lower(k)))


def evidence(golden: DataFrame, docs: DataFrame, most: int = KEYWORDS) -> DataFrame:
    """id, evidence: whether any document that the question allows (docs: names, null for all) holds a keyword, in either case.
    golden: id, docs, kw; docs: doc, text.

    Up to `most` keywords go to all tasks as one automaton, which reads each text once, whatever their number; what leaves a task is the
    keywords found by document name, each once. More keywords meet the texts by the longest of their inner tokens (_by_tokens).
    """
    each = golden.select("id", "docs", F.explode(F.array_compact("kw")).alias("kw")).withColumn("kw", F.lower("kw"))
    local = each.select("kw").distinct().limit(most + 1).toArrow()
    if local.num_rows > most:
        found = _by_tokens(each, docs)
    else:
        words = sorted(local["kw"].to_pylist())
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, every = ahocorasick.Automaton(), "" in shared.value
            for w in filter(None, shared.value):
                automaton.add_word(w, w)
            automaton.make_automaton()
            told: set[tuple] = set()
            for batch in batches:
                new = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text is None:
                        continue
                    held = {w for _, w in automaton.iter(text)} if len(automaton) else set()
                    for w in held | ({""} if every else set()):
                        if (doc, w) not in told:
                            new.append((doc, w))
                            told.add((doc, w))
                if len(told) > TOLD:
                    told.clear()
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], batch.column(0).type), pa.array([w for _, w in new], pa.string())], names=["doc", "kw"])

        rows = docs.select("doc", F.lower("text").alias("text")).mapInArrow(run, f"doc {dict(docs.dtypes)['doc']}, kw string").distinct()
        found = each.join(rows, "kw").where(_allowed()).select("id")
    found = found.distinct().withColumn("_hit", F.lit(True))
    return golden.select("id").join(found, "id", "left").select("id", F.coalesce("_hit", F.lit(False)).alias("evidence"))


def _allowed() -> Column:
    return F.col("docs").isNull() | F.array_contains("docs", F.col("doc"))


def _by_tokens(each: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids of rows (id, docs, kw) whose keyword a document holds. A keyword's tokens but the first and the last are whole tokens of a text that
    holds it, so the longest of them leads by an equal join to the few texts in which the keyword is then looked for. Keywords of one
    or two tokens are looked for in every text."""
    each = each.withColumn("_t", tokens(F.col("kw")))
    inner = F.slice("_t", 2, F.greatest(F.size("_t") - 2, F.lit(0)))
    key = F.try_element_at(F.array_sort(inner, lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0))), F.lit(1))
    each = each.select("id", "docs", "kw", key.alias("_key"))
    led, short = if_small(each.where("_key IS NOT NULL")), each.where("_key IS NULL").drop("_key")
    held = docs.select("doc", "text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("_key"))
    holds = F.contains(F.lower("text"), F.col("kw"))
    found = held.join(led, "_key").where(_allowed() & holds).select("id")
    return found if short.isEmpty() else found.union(docs.join(if_small(short), _allowed() & holds).select("id"))


def first_hits(golden: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """id, path, first_rank: the smallest rank up to k with an allowed document and a keyword; null if there is none.

    hits: id, path (the way of retrieval), rank, doc, text."""
    ok = (F.col("rank") <= k) & (F.col("docs").isNull() | F.array_contains("docs", F.col("doc"))) & any_keyword(F.col("text"), F.col("kw"))
    both = hits.join(if_small(golden.select("id", "docs", "kw")), "id")
    return both.groupBy("id", "path").agg(F.min(F.when(ok, F.col("rank"))).alias("first_rank"))


def recall(first: DataFrame, evidenced: DataFrame) -> DataFrame:
    """path, questions, hits, recall over the questions with evidence; and a row for all paths together, path 'union'."""
    rows = first.join(evidenced.where("evidence").select("id"), "id")
    # each answer counts for its own path and for all paths together
    each = rows.select(F.explode(F.array("path", F.lit("union"))).alias("path"), "id", F.col("first_rank").isNotNull().alias("hit"))
    once = each.groupBy("path", "id").agg(F.bool_or("hit").cast("int").alias("hit"))
    return once.groupBy("path").agg(F.count("*").alias("questions"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("recall"))
