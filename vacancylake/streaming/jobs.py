"""Structured Streaming forms of the batch jobs."""
from __future__ import annotations

from datetime import datetime, timezone
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ingest as I
from ..operators.ops import LIVENESS_EVENT, OPEN_EVENT


def stream_upsert(batches: DataFrame, sources: DataFrame, read_store, publish, checkpoint: str, now_of=None):
    """Upsert every micro-batch into the stored table.

    The sticky rules need the whole table, so each batch reads the store, writes a new
    version named by the batch id and publishes it. now_of(batch_id) gives a batch its
    own time, by default the wall clock (UTC) when it runs.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        now = now_of(batch_id) if now_of else datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        stored = read_store(batch.sparkSession)
        jobs, events, _counts = I.upsert_jobs(stored, I.normalize_jobs(batch, sources), now)
        publish(jobs, events, batch_id)

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")


def stream_upsert_buckets(batches: DataFrame, sources: DataFrame, store, checkpoint: str, now_of=None):
    """Upsert every micro-batch into a bucketed store (sources.buckets.JobStore): only the buckets it touches are rewritten."""
    def write(batch: DataFrame, batch_id: int) -> None:
        now = now_of(batch_id) if now_of else datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        store.upsert(I.normalize_jobs(batch, sources), now, batch_id)

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")


def stream_events(events: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Milestones once per event key; duplicates inside the watermark are dropped."""
    return events.withWatermark("occurred_at", watermark).dropDuplicatesWithinWatermark(["event_key"])


def stream_event_counts(events: DataFrame, watermark: str = "1 day", sliding: bool = False) -> DataFrame:
    """Event counts and probe outcomes by day, or by seven days sliding daily; late rows are dropped."""
    w = F.window("created_at", "7 days", "1 day") if sliding else F.window("created_at", "1 day")
    result = F.get_json_object("payload", "$.result")
    probe = F.col("event") == LIVENESS_EVENT
    return events.withWatermark("created_at", watermark).groupBy(w.alias("window"), "event").agg(
        F.count("*").alias("n"), F.count_if(F.col("event") == OPEN_EVENT).alias("opens"),
        F.count_if(probe & (result == "alive")).alias("alive"), F.count_if(probe & (result == "dead")).alias("dead"))


class SurgeProcessor(StatefulProcessor):
    """Keeps the last count of a source and reports jumps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "campus_count long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("captured_at")
        previous = self.last.get()[0] if self.last.exists() else None
        out = []
        for at_, count in zip(seen["captured_at"], seen["campus_count"]):
            count = int(count)
            jump = previous is not None and count > previous and ((previous > 0 and count >= 3 * previous) or count >= previous + 50)
            out.append((key[0], at_, previous, count, jump))
            previous = count
        self.last.update((previous,))
        yield pd.DataFrame(out, columns=["source_id", "captured_at", "prev_count", "campus_count", "surge"]).astype({"prev_count": "Int64"})

    def close(self) -> None:
        pass


SURGE_SCHEMA = "source_id string, captured_at timestamp, prev_count long, campus_count long, surge boolean"


def stream_surges(snapshots: DataFrame) -> DataFrame:
    """Surge flags with one remembered count per source."""
    return snapshots.groupBy("source_id").transformWithStateInPandas(SurgeProcessor(), SURGE_SCHEMA, "append", "none")


def stream_sessions(runs: DataFrame, gap: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Runs of a user grouped while they follow each other within the gap."""
    return runs.withWatermark("created_at", watermark).groupBy(F.session_window("created_at", gap).alias("session"), "user_id").agg(F.count("*").alias("runs"))
