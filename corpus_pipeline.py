"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tindra.llm import decontamination, near_copies, packing, secret_scan, shared, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, shared.table(spark, sf_dir, "labels"), "toxic", ~shared.held_out("doc_id", 4, 2))
    return toxicity.drop_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; rows that share
    an id stay or go together, rows without one stay."""
    kept = near_copies.near_copies(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_leaks(docs, shared.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    found = secret_scan.scan(docs)
    changed = F.exists("findings", lambda f: f["secret"])
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_copies),
    ("decontamination", without_leaks),
    ("secret_scan", without_secrets),
    ("packing", packed),
]
ORACLE_SQL = None  # classifiers and tokenisers are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
