"""Queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.shared import ship

#: query name -> module with query(spark, sf_dir), and ORACLE_SQL where SQL can say it
MODULES = {
    "op1_quality": "quality",
    "op2_chroma": "chroma",
    "op3_huffman_ids": "huffman_ids",
    "op4_decontaminate": "decontaminate",
    "op5_near_dedup": "near_dedup",
    "op6_secrets": "secrets",
    "op7_token_counts": "token_counts",
    "op8_html_text": "html_text",
    "op9_toxicity": "toxicity",
    "op10_bpe": "bpe",
    "op11_shards": "shards",
    "op12_lexical": "lexical",
    "op13_resample": "resample",
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return import_module(f"lattica.llm.{MODULES[name]}").query(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"lattica.llm.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
