"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, mixing, order_minhash, spans, toxicity
from granary.llm.common import Scratch
from granary.llm.queries import table, toxicity_model


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that reach their language's threshold; null, empty and blank texts have the score of no evidence. Labels
    come from sf_dir; if they don't name both classes, all documents stay. Repeated rows are decided alike."""
    return toxicity.reject(docs, toxicity_model(spark, docs, sf_dir))


def one_of_each_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest doc_id; null and blank texts all stay."""
    return order_minhash.keep_one(docs)


def repeated_spans_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without spans that a document of a smaller doc_id has; null ids come last. n_chars is made to fit;
    other columns stay as they are, those with the operator's own names too."""
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in ("n_sentences", "n_removed")}
    out = spans.dedup(docs.withColumnsRenamed(aside)).drop("n_sentences", "n_removed")
    return out.withColumnsRenamed({b: a for a, b in aside.items()}).select(docs.columns)


def benchmark_leaks_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item within its error budget; null and empty texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sources_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with how often each is taken (copies), how many words that is, and its turn; columns of docs that
    have these names are replaced. Null sources are one source; texts without words aren't taken."""
    own = ("copies", "taken", "finish")
    return mixing.mix(docs).where("copies > 0").select(*(c for c in docs.columns if c.lower() not in own), *own)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("order minhash near-dedup", one_of_each_near_duplicate),
    ("sentence span dedup", repeated_spans_go),
    ("benchmark decontamination", benchmark_leaks_go),
    ("mixing to weights", sources_to_weights),
]

#: The stages' classifier, sketches and edit distances are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, keep = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = keep.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            keep.drop(f"stage-{i - 1}")
    return docs
