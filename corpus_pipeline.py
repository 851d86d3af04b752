"""A corpus pipeline of five operators; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huegrain.llm import language_id as lid
from huegrain.llm import toxicity as tox
from huegrain.llm.common import materialize
from huegrain.llm.contracts import tokenizer_file
from huegrain.llm.exact_dedup import exact_dedup
from huegrain.llm.jaccard_join import jaccard_components
from huegrain.llm.packing import retrieval_pack

#: A text is rejected by language ID when it has no letter, or when two languages are as good and neither is likely.
LEAST_LANGUAGE_SCORE = 0.4


def _own(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    there = {c.lower() for c in docs.columns}
    while name in there:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, written once (ids can be null or repeat), and that column's name."""
    row = _own(docs, "_row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _first(rows: DataFrame, row: str, groups: DataFrame, *order) -> DataFrame:
    """The first row, by ``order``, then id (null last), then number, of each group of (number, _group)."""
    places = rows.select(row, F.struct(*order, F.col("doc_id").isNull().alias("none"), "doc_id", row).alias("_place"))
    best = groups.join(places, row).groupBy("_group").agg(F.min("_place").alias("b")).select(f"b.{row}")
    return rows.join(best, row, "left_semi").drop(row)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null and letterless texts go, and those that no language fits. A row is judged by its text alone, of any
    length, so repeated rows fare alike; other columns stay, whatever their names."""
    said = lid.predictor(lid.fit(docs))(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    at = _own(docs, "_said")
    keep = (F.col(f"{at}.lang_pred") != "und") & ~(F.col(f"{at}.ambiguous") & (F.col(f"{at}.score") < LEAST_LANGUAGE_SCORE))
    return docs.withColumn(at, said).filter(keep).drop(at)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict toxic. A null text counts as empty; a score of exactly one half is toxic; rows are judged
    alone, whole; other columns stay, whatever their names."""
    model = tox.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = tox.scorer(model)(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    at = _own(docs, "_score")
    return docs.withColumn(at, score).filter(F.col(at) < 0.5).drop(at)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the smallest id (null last), then any of the
    rows that are alike in both. Null and empty texts are one group; other columns stay, whatever their names."""
    rows, row = _numbered(docs)
    groups = exact_dedup(rows, id_col=row).select(F.col("doc_id").alias(row), F.col("keep_id").alias("_group"))
    return _first(rows, row, groups, (-F.length(F.coalesce("text", F.lit("")))).alias("short"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null last), of each component of near copies (five words, 0.8). Texts without words are near
    nothing and stay; other columns stay, whatever their names."""
    rows, row = _numbered(docs)
    found = jaccard_components(rows, id_col=row, words=5, pct=80, numbered=True)
    return _first(rows, row, found.select(F.col("doc_id").alias(row), F.col("component_id").alias("_group")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 1024 tokens."""
    return retrieval_pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language_id", by_language), ("toxicity", not_toxic), ("exact_dedup", exact), ("ngram_jaccard", near), ("packing", packed)]

#: The models and the packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
