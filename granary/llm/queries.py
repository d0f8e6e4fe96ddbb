"""The operators applied to the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, gru_lm, html_cut, licenses, mixing, order_minhash, packing, spans, topk, toxicity, variants, zip_warc

LEARN_MOD, LEARN_REST = 4, 2  # labels of documents with this remainder are held out
LM_MOD, LM_REST = 5, 1
TOXIC_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model | None:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.bucket(F.col("doc_id"), LEARN_MOD) != LEARN_REST)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        (toxicity.bucket(F.col("doc_id"), LEARN_MOD) == LEARN_REST).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        "threshold",
        (F.col("score") >= F.col("threshold")).alias("rejected"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents"), toxicity.bucket(F.col("doc_id"), LM_MOD) == LM_REST)


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages"))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_warc.round_trip(table(spark, sf_dir, "pages"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_toxicity, op3_licenses, op4_mixing, op5_gru_lm, op6_sentence_spans, op7_html_main_text, op8_zip_warc, op9_exact_top_k, op10_order_minhash, op11_spelling_variants, op12_collocations, op13_packing)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licenses": licenses.scan_sql(),
        "op4_mixing": mixing.mix_sql(),
        "op8_zip_warc": zip_warc.round_trip_sql(),
        "op9_exact_top_k": topk.top_k_sql(),
        "op11_spelling_variants": variants.group_sql(),
        "op12_collocations": collocations.mine_sql(),
    }
