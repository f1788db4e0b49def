"""Helpers shared by the corpus operators: stored tables, held-out rows, connected components."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where the setting is missing (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 marks a held-out row. Null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable over undirected edges. Nodes are those of the edges.

    Each round takes the smallest label among neighbours, hooks the old label to it and jumps one pointer, so long
    chains shrink by doubling. Rounds end when the sum of all labels (as text-free decimal) stops changing. Only that
    sum and a row count reach the driver.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(both.union(both.select("v", "u")).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label"))
    labels, last = stored(labels, "labels"), None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now is None or now == last:
            return labels
        last = now
        near = (both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        hook = step.where("best < label").groupBy(F.col("label").alias("node")).agg(F.min("best").alias("hook"))
        step = step.join(hook, "node", "left").select("node", F.least("best", F.coalesce("hook", "best")).alias("best"))
        step = stored(step, "step")
        jump = step.select(F.col("node").alias("best"), F.col("best").alias("far"))
        labels = stored(step.join(jump, "best", "left").select("node", F.least("best", F.coalesce("far", "best")).alias("label")), "labels")


def numbered(rows: DataFrame, order: list[str], within: str | None = None) -> DataFrame:
    """rows plus pos (from 0, in ascending order, nulls first) and total, of the table or of each value of `within`.

    Rows are dealt by range of (within, order), so one large value is split; only counts per partition are summed in a
    window. Rows equal in all order columns get any order among themselves. `within` must not be null.
    """
    keys = [within, *order] if within else order
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), place.alias("_seq"))
    dealt = stored(dealt, "numbered")
    group = [within] if within else []
    sizes = dealt.groupBy(*group, "_part").agg(F.min("_seq").alias("_low"), F.count("*").alias("_n"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "_part", (before - F.col("_low")).alias("_shift"), F.sum("_n").over(over).alias("total"))
    return dealt.join(sizes, [*group, "_part"]).select(*rows.columns, (F.col("_seq") + F.col("_shift")).alias("pos"), "total")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts stay small: at most this many rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
