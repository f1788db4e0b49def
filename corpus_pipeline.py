"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vacancylake.llm.common import shared_folder, table
from vacancylake.llm.stages import STAGES

ORACLE_SQL = None  # a fitted classifier and a packing are not SQL; tests compare run() with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
