"""A posting store in hash buckets of the canonical URL, so that a batch rewrites only the buckets it touches."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import ingest as I

BUCKETS = 256
FILES_PER_BUCKET = 4


class JobStore:
    """Layout under root: data/v=<batch>/_bucket=<n> (postings), events/v=<batch>, log/batch=<batch> (which buckets a batch wrote).

    A batch is visible once its log entry is written, which is the last step; a batch that is run again writes the same
    files, and one whose entry is there is left alone. Readers take the newest version of every bucket. The number of
    buckets is fixed for the life of a store.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, buckets: int = BUCKETS, files: int = FILES_PER_BUCKET):
        self.spark, self.root, self.schema, self.buckets, self.files = spark, root.rstrip("/"), schema, buckets, files

    def bucket(self, url="canonical_jd_url") -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def versions(self) -> dict[int, int]:
        """Newest version of each bucket; at most one entry a bucket reaches the driver."""
        if not self._exists(f"{self.root}/log"):
            return {}
        log = self.spark.read.schema("bucket int, version long").parquet(f"{self.root}/log/batch=*")
        return {r["bucket"]: r["version"] for r in log.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def read(self, buckets=None) -> DataFrame:
        """Postings of some buckets, or of all."""
        wanted = self.versions()
        paths = [f"{self.root}/data/v={v}/_bucket={b}" for b, v in sorted(wanted.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def events(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/events/v=*") if self._exists(f"{self.root}/events") else None

    def upsert(self, batch: DataFrame, now, batch_id: int) -> list[int]:
        """Merges a batch (ingest.upsert_jobs) and returns the buckets it rewrote. Rows without a URL are left out."""
        if self._exists(f"{self.root}/log/batch={batch_id}"):
            return []
        rows = batch.where("trim(canonical_jd_url) <> ''")
        touched = sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())
        if touched:
            jobs, events, _ = I.upsert_jobs(self.read(set(touched)), rows, now)
            spread = jobs.withColumn("_bucket", self.bucket()).repartition("_bucket", F.pmod(F.xxhash64("id"), F.lit(self.files)))
            spread.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/data/v={batch_id}")
            events.write.mode("overwrite").parquet(f"{self.root}/events/v={batch_id}")
        entries = self.spark.createDataFrame([(b, batch_id) for b in touched], "bucket int, version long")
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/batch={batch_id}")
        return touched
