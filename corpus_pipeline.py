"""Cleaning of a training corpus in stages; each reads what the one before it wrote.

Defined results, of all stages: rows whose doc_id is null, texts that are null, empty or very
long, rows that repeat and an empty table are allowed; other columns, whatever their names, are
carried through by all stages but the last, which returns digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bpe, decontaminate, near_dedup, quality, secrets
from lattica.llm.shared import ship, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; empty texts are judged like others, equal rows alike."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the least doc_id, with all rows that share it; empty texts and null ids all stay."""
    ship(spark)
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, every row of them; empty texts and null ids stay."""
    ship(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked, and n_chars set anew where there is one; all rows stay, null texts as they are."""
    ship(spark)
    return secrets.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row the number of ids, and hashes of the ids and of the text decoded from them; a null text counts as empty."""
    ship(spark)
    return bpe.digest(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", bpe_stage),
]
ORACLE_SQL = None  # a discriminant's scores and BPE are beyond SQL; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"stage{k}")
    return docs
