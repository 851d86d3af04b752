"""opN_<name>: each applies its operator, with production parameters, to the whole table it is meant for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id as lid
from . import toxicity as tox
from .bpe import encode_decode
from .chat_format import render_chats
from .chat_repair import damaged, repair_report
from .collocations import collocations
from .exact_dedup import exact_dedup
from .fingerprints import neighbour_fingerprints
from .jaccard_join import jaccard_components
from .license_scan import license_scan
from .line_dedup import line_dedup
from .mixing import mix_plan
from .packing import retrieval_pack
from .registry import table


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; HUEGRAIN_TOKENIZERS names another folder that has it."""
    if folder := os.environ.get("HUEGRAIN_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, pct=85).drop("row_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), with_ids=False)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tox.toxicity(docs, tox.fit(docs, table(spark, sf_dir, "labels")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source and language."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(docs.select("doc_id", path.alias("path"), "text")).withColumnRenamed("id", "doc_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chats(table(spark, sf_dir, "conversations"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lid.language_id(docs, lid.fit(docs))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_report(damaged(turns), turns)
