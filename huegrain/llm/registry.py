"""The thin contract queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: query name -> (module, function), imported when the query is asked for
CONTRACTS = {
    "op1_line_dedup": ("contracts", "op1"),
    "op2_retrieval_packing": ("contracts", "op2"),
    "op3_ngram_jaccard": ("contracts", "op3"),
    "op4_bpe_words": ("contracts", "op4"),
    "op5_toxicity": ("contracts", "op5"),
    "op6_exact_dedup": ("contracts", "op6"),
    "op7_license_scan": ("contracts", "op7"),
    "op8_chat_format": ("contracts", "op8"),
    "op9_language_id": ("contracts", "op9"),
    "op10_order_minhash": ("contracts", "op10"),
    "op11_phrase_collocations": ("contracts", "op11"),
    "op12_source_mixing": ("contracts", "op12"),
    "op13_chat_repair": ("contracts", "op13"),
}


def queries() -> dict:
    def bound(module: str, function: str):
        return lambda spark, sf_dir: getattr(importlib.import_module(f"{__package__}.{module}"), function)(spark, sf_dir)

    return {name: bound(*where) for name, where in CONTRACTS.items()}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
