"""Stages of the corpus pipeline: (name, function of spark, docs, sf_dir). All but the last return the columns of docs."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylake.llm import jaccard_join, line_dedup, packing, quality, secrets
from vacancylake.llm.common import table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of an earlier document; a document may become empty but stays."""
    made = line_dedup.dedup_lines(docs, out="line_dedup_result")
    return _counted(made.select(*[F.col("line_dedup_result.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return jaccard_join.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return _counted(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_deduplication), ("jaccard_join", jaccard_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]
