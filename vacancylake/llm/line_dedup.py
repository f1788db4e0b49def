"""Incremental, reversible line deduplication: exact reference-count tables behind sharded cuckoo filters."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vacancylake.llm import cuckoo
from vacancylake.llm.common import bounded_batches, stored

BLANK = b" \t\n\x0b\x0c\r"
MIN_POINTS = 10  # code points a key needs
SHARD_KEYS = 100_000  # keys of one filter shard


def line_key(line: bytes) -> bytes | None:
    """16-byte digest of a stripped, A-Z lower-cased line; None if it is too short to count."""
    key = line.strip(BLANK).lower()  # bytes: only A-Z change
    if len(key) < MIN_POINTS or len(key) < 4 * MIN_POINTS and len(key.decode()) < MIN_POINTS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def document_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id), one row for each distinct key of a row of docs. Rows without id or text have none."""
    bounded_batches(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, keys = [], []
            for i, t in zip(part["doc_id"], part["text"]):
                own = {line_key(x) for x in t.encode().split(b"\n")} - {None}
                keys.extend(own)
                ids.extend([i] * len(own))
            yield pd.DataFrame({"key": keys, "doc_id": np.array(ids, np.int64)})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInPandas(run, "key binary, doc_id long")


@dataclass(frozen=True)
class LineIndex:
    """A version of the index. insert() and delete() return the next version; a deletion restores what was before.

    refs: (key, doc_id), which document holds which key. counts: (key, n, first_doc), exact. filters: (shard, slots),
    a cuckoo filter for each shard of keys; only keys that it may hold are looked up in counts.
    """
    spark: SparkSession
    refs: DataFrame | None = None
    counts: DataFrame | None = None
    filters: DataFrame | None = None
    shards: int = 0
    buckets: int = 0

    def insert(self, lines: DataFrame) -> LineIndex:
        """Adds (key, doc_id) rows. Rows that are there already, or repeat in the batch, change nothing."""
        new = lines.select("key", "doc_id").distinct()
        if self.refs is None:
            refs = stored(new, "refs")
            counts = stored(refs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")), "counts")
            return LineIndex(self.spark, refs, counts).rebuilt()
        new = stored(new.join(self.refs, ["key", "doc_id"], "left_anti"), "batch")
        batch = new.groupBy("key").agg(F.count("*").alias("n2"), F.min("doc_id").alias("first2"))
        batch = stored(self._probe(batch), "probed")
        seen = self.counts.join(batch.where("maybe").select("key", "n2", "first2"), "key", "full_outer")
        counts = seen.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.least("first_doc", "first2").alias("first_doc"), F.col("n").isNull().alias("fresh"))
        counts = stored(counts.union(batch.where("not maybe").select("key", "n2", "first2", F.lit(True))), "counts")
        after = replace(self, refs=self.refs.union(new), counts=counts.drop("fresh"))
        if counts.count() > self.shards * self.buckets * cuckoo.SLOTS * cuckoo.LOAD:
            return after.rebuilt()
        return after._changed(counts.where("fresh").select("key"), cuckoo.insert)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes out all lines of the documents in column doc_id; unknown or repeated ids change nothing."""
        if self.refs is None:
            return self
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        touched = stored(self.refs.join(ids, "doc_id", "left_semi").select("key").distinct(), "touched")
        refs = stored(self.refs.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "refs")
        again = stored(refs.join(touched, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")), "again")
        counts = stored(self.counts.join(touched, "key", "left_anti").union(again), "counts")
        return replace(self, refs=refs, counts=counts)._changed(touched.join(again, "key", "left_anti"), cuckoo.remove)

    def rebuilt(self, spare: int = 1) -> LineIndex:
        """Filters built anew from the exact counts, with room for as many keys again."""
        keys = self.counts.count()
        shards = max(1, -(-2 * keys // SHARD_KEYS))
        buckets = cuckoo.buckets_for(min(SHARD_KEYS, 2 * keys + 1) * 5 // 4) * spare

        def build(part: pd.DataFrame) -> pd.DataFrame:
            tab = cuckoo.empty(buckets)
            ok = cuckoo.insert(tab, list(part["key"]))
            return pd.DataFrame({"shard": part["shard"].iloc[:1], "slots": [tab.tobytes()], "ok": [bool(ok)]})

        keyed = self.counts.select("key", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
        made = stored(keyed.groupBy("shard").applyInPandas(build, "shard long, slots binary, ok boolean"), "filters")
        if made.where("not ok").limit(1).count():
            return self.rebuilt(spare * 2)
        return replace(self, filters=made.drop("ok"), shards=shards, buckets=buckets)

    def _by_shard(self, keys: DataFrame):
        keyed = keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)))
        return keyed.groupBy("shard").cogroup(self.filters.groupBy("shard"))

    def _probe(self, batch: DataFrame) -> DataFrame:
        """Adds `maybe`: false only if the key is surely not in the index."""
        def probe(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            tab = np.frombuffer(own["slots"].iloc[0], np.uint16).reshape(-1, cuckoo.SLOTS) if len(own) else cuckoo.empty(1)
            return part.assign(maybe=cuckoo.contains(tab, list(part["key"])) if len(part) else np.zeros(0, bool))[["key", "n2", "first2", "maybe"]]

        return self._by_shard(batch).applyInPandas(probe, "key binary, n2 long, first2 long, maybe boolean")

    def _changed(self, keys: DataFrame, change) -> LineIndex:
        buckets = self.buckets

        def run(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            tab = np.frombuffer(own["slots"].iloc[0], np.uint16).reshape(-1, cuckoo.SLOTS).copy() if len(own) else cuckoo.empty(buckets)
            ok = not len(part) or change(tab, list(part["key"])) is not False
            return pd.DataFrame({"shard": [(own if len(own) else part)["shard"].iloc[0]], "slots": [tab.tobytes()], "ok": [bool(ok)]})

        made = stored(self._by_shard(keys).applyInPandas(run, "shard long, slots binary, ok boolean"), "filters")
        if made.where("not ok").limit(1).count():
            return self.rebuilt()
        return replace(self, filters=made.drop("ok"))

    def drops(self, lines: DataFrame) -> DataFrame:
        """(drop_id, keys): what a document loses: keys of two or more documents of which it is not the first."""
        shared = self.counts.where("n >= 2").select("key", "first_doc")
        return (lines.join(shared, "key").where("doc_id <> first_doc").groupBy(F.col("doc_id").alias("drop_id"))
                .agg(F.collect_set("key").alias("keys")))


@F.pandas_udf(StructType().add("text", "string").add("n_lines", "long").add("n_dropped", "long"))
def _without(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
    out = []
    for t, own in zip(text, keys):
        lines = (t or "").encode().split(b"\n")
        if own is None or not len(own):
            out.append((t or "", len(lines), 0))
            continue
        own = set(own)
        kept = [x for x in lines if line_key(x) not in own]
        out.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2, out: str = "line_dedup") -> DataFrame:
    """docs plus a struct column `out` (text, n_lines, n_dropped): the text without lines that an earlier document holds.

    The documents enter a new index in batches, so that all but the first pass the filters. Lines of fewer than ten
    code points (after stripping) stay. A null or empty text is one empty line and becomes empty. Rows with a null id
    keep their lines and count for nobody. Rows that share an id are one document. Repeated lines of the first holder
    stay, also when they repeat there. Other columns pass unread; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    lines = stored(document_lines(docs, doc_id, text), "lines")
    index = LineIndex(docs.sparkSession)
    for k in range(batches):
        index = index.insert(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    drops = index.drops(lines)
    made = docs.join(drops, docs[doc_id].cast("long") == drops["drop_id"], "left")
    return made.select(*[docs[c] for c in docs.columns], _without(docs[text], drops["keys"]).alias(out))
