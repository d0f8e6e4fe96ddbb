"""Jobs over a corpus: build its tables, search them, evaluate the search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.sizes import if_small
from granary.functions.text import quota_bucket, source_label, word_count
from granary.jobs.scratch import saved
from granary.operators import chunking, fusion, maintenance, shaping
from granary.sources import tables
from granary.sources.postings import Postings


def ingest(spark: SparkSession, pages: DataFrame, folder: str, stored: Postings | None = None) -> int:
    """Chunks the pages (doc_id, page, text, content_md5) of contents that the table doesn't have and appends them; the
    first name of each content counts. With stored postings (of id; by columns of the chunks), these get the new chunks too, which are
    written aside first, so that no page is chunked twice. Returns the rows added."""
    names = pages.select("doc_id", "content_md5").distinct()
    chosen = maintenance.elect(names, ["content_md5"], ["doc_id"])
    try:
        chosen = tables.new_rows(chosen, spark.read.parquet(folder), ["doc_id"])
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    keyed = pages.join(chosen, ["doc_id", "content_md5"]).withColumn("key", F.struct("doc_id", "page"))
    parts = chunking.chunk_pages(keyed.select(F.to_json("key").alias("doc_id"), "text"))
    where = F.from_json("doc_id", keyed.schema["key"].dataType.simpleString())
    rows = parts.withColumn("key", where).drop("doc_id").select("key.doc_id", "key.page", "chunk_part", "total_parts", "text", "block_kind", "clause")
    rows = rows.withColumn("id", F.sha2(F.concat_ws("/", "doc_id", "page", "chunk_part"), 256))
    if stored:
        rows = saved(spark, rows)
    added = Observation()  # counted as they are written
    rows.observe(added, F.count("*").alias("n")).write.mode("append").parquet(folder)
    n = added.get["n"]
    if stored and n:
        stored.append(rows)
    return n


def search(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int = 5,
    answer_context: int = 15,
    per_doc: int = 2,
    current_only: bool = True,
    diagrams_only: bool = False,
    mode: str = "hybrid",
    stored: Postings | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(display, evidence) for queries: filtered, retrieved, stitched and shaped twice.

    mode "hybrid": by terms and vectors, fused; queries: query_id, text, embedding; stored: the chunks' postings, if there are any.
    mode "late": by vectors, then by late interaction; queries: query_id, embedding, tokens (vectors), and chunks have tokens.
    chunks: id, text, embedding, is_current, has_diagram, doc_id, page, chunk_part, total_parts, content_md5; what else it has
    (spec_id, edition, filename, heading, diagram_paths) goes with the excerpts, for context.

    The stitched hits are a table in the shared folder, so both shapes come of one search; of the chunks, only those found are joined.
    """
    n, spark = shaping.budgets(top_k, answer_context), chunks.sparkSession
    if mode == "late":
        found = fusion.late(chunks, queries, n["rerank"], n["prefetch"], current_only, diagrams_only, "id")
    elif mode == "hybrid":
        found = fusion.hybrid(chunks, queries, n["candidates"], n["hybrid_prefetch"], current_only, diagrams_only, "id", stored)
    else:
        raise ValueError(f"no search mode {mode}")
    found = saved(spark, found)
    hits = if_small(found).join(chunks.drop("embedding", "tokens").withColumnRenamed("text", "content"), "id")
    hits = saved(spark, shaping.stitch_parts(hits, ["query_id", "doc_id", "page"]))
    bucket = quota_bucket(F.col("content_md5"), F.col("doc_id").cast("string"), F.col("content"))
    return shaping.shape(hits, bucket, top_k, 1), shaping.shape(hits, bucket, answer_context, per_doc)


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def context(evidence: DataFrame) -> DataFrame:
    """query_id, context: the excerpts in order, each under a line that has its number, name, heading and diagrams."""
    name = source_label(_column(evidence, "spec_id"), F.coalesce(_column(evidence, "filename"), _column(evidence, "doc_id")), _column(evidence, "edition"), _column(evidence, "page"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    diagrams = F.nullif(F.array_join(_column(evidence, "diagram_paths", "array<string>"), ", "), F.lit(""))
    head = F.concat(F.lit("--- [Source "), place.cast("string"), F.lit("] "), F.concat_ws(" \u2014 ", name, F.nullif(_column(evidence, "heading"), F.lit("")), F.concat(F.lit("Diagrams: "), diagrams)))
    rows = evidence.select("query_id", place.alias("i"), F.concat(head, F.lit("\n"), F.coalesce("content", F.lit(""))).alias("e"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "e")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["e"]), "\n\n").alias("context"))


def answer_counts(evidence: DataFrame) -> DataFrame:
    """query_id, excerpts, words, merged (excerpts stitched of several parts)."""
    return evidence.groupBy("query_id").agg(
        F.count("*").alias("excerpts"), F.sum(word_count(F.col("content")).cast("long")).alias("words"), F.count_if(F.coalesce("stitched_parts", F.lit(1)) > 1).alias("merged")
    )
