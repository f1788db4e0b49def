"""Consistent weighted sampling: fingerprints of weighted term sets that collide as often as the sets are alike.

For each of K samples a term with weight w draws r and c from gamma(2, 1) and b from (0, 1), all fixed by the term. With
t = floor(ln w / r + b), the sample is the pair (term, t) of least c * exp(-r * (t - b + 1)). Two texts take the same pair
with probability sum(min weights) / sum(max weights), the generalised Jaccard similarity.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.common import bounded_batches, numbered

SAMPLES = 128  # samples of a fingerprint; each is kept as 16 bits
CACHED = 120_000  # terms whose random numbers a task remembers, 0.5 kB each
TERMS = 4096  # terms of a text that are sampled at a time
PART_CHARS = 64_000_000  # characters a range of documents should hold
PARTS = 50_000  # ranges at most
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer, in place."""
    for shift, odd in ((30, ODD[1]), (27, ODD[2])):
        x ^= x >> np.uint64(shift)
        x *= odd
    x ^= x >> np.uint64(31)
    return x


def _units(x: np.ndarray) -> np.ndarray:
    """32-bit numbers as floats between 0 and 1."""
    return (x.astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -32 - 2.0 ** -56)


def terms(text: str) -> Counter:
    """Words between blanks, A-Z lower-cased, with their counts as weights."""
    return Counter(text.encode().lower().split())


class Remembered:
    """Rows of numbers for terms; when `size` rows are taken, all are forgotten. What a row holds depends on its term alone."""

    def __init__(self, size: int, *shapes: tuple):
        self.size, self.rows = size, {}
        self.tables = [np.empty((size, *shape), kind) for kind, shape in shapes]

    def find(self, words: list[bytes], make) -> np.ndarray:
        """Row of each word; make(new words) gives the tables' rows of words that are not held, 64 at a time."""
        rows = self.rows
        found = [rows.get(w, -1) for w in words]
        if -1 not in found:
            return np.array(found, np.int64)
        new = [w for w, row in zip(words, found) if row < 0]
        if len(rows) + len(new) > self.size:
            rows.clear()
            new, found = words, [-1] * len(words)
        for at in range(0, len(new), 64):  # few at a time stay in the processor's cache
            some, low = new[at:at + 64], len(rows)
            for table, made in zip(self.tables, make(some)):
                table[low:low + len(some)] = made
            rows.update(zip(some, range(low, low + len(some))))
        return np.array([rows[w] if row < 0 else row for w, row in zip(words, found)], np.int64)


class Sampler:
    """Fingerprints of weighted terms. Random numbers depend on the term alone and are remembered for a bounded number."""

    def __init__(self, samples: int = SAMPLES, cached: int = CACHED):
        cached = max(cached, 2 * TERMS)
        self.samples, self.row = samples, (np.float32, (samples,))
        self.steps = np.arange(2 * samples, dtype=np.uint64)[None, :] * ODD[0]
        self.light = Remembered(cached, (np.uint64, ()), self.row)  # key, score of weight 1
        self.heavy = Remembered(max(cached // 10, 2 * TERMS), self.row, self.row, self.row)  # r, ln c, b

    def _draw(self, key: np.ndarray) -> tuple[np.ndarray, ...]:
        drawn = _mix(key[:, None] + self.steps).view(np.uint32).reshape(-1, 4, self.samples)
        u, spare = _units(drawn), drawn & np.uint32(255)  # a float has no room for the lowest bits: they make b
        b = _units(spare[:, 0] << np.uint32(24) | spare[:, 1] << np.uint32(16) | spare[:, 2] << np.uint32(8))
        return -np.log(u[:, 0] * u[:, 1]), np.log(-np.log(u[:, 2] * u[:, 3])), b

    def _first(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        key = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        r, c, b = self._draw(key)
        return key, c - r * (1 - b)  # t is 0 at weight 1

    def fingerprint(self, weights: dict[bytes, float]) -> np.ndarray:
        """One 16-bit code per sample; none at all for an empty set."""
        if not weights:
            return np.zeros(0, np.uint16)
        words, k = list(weights), np.arange(self.samples)
        best, code = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64)
        for at in range(0, len(words), TERMS):
            own = words[at:at + TERMS]
            rows = self.light.find(own, self._first)
            key, score = self.light.tables[0][rows], self.light.tables[1][rows]
            weight = np.fromiter(map(weights.__getitem__, own), np.float32, len(own))
            heavy = np.flatnonzero(weight != 1)
            some = self.heavy.find([own[i] for i in heavy], lambda new: self._draw(np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)))
            r, c, b = (table[some] for table in self.heavy.tables)
            t = np.floor(np.log(weight[heavy])[:, None] / r + b)
            score[heavy] = c - r * (t - b + 1)
            row = score.argmin(axis=0)
            least, step = score[row, k], np.zeros(self.samples, np.int64)
            weighty = weight[row] != 1
            step[weighty] = t[np.searchsorted(heavy, row[weighty]), k[weighty]]
            found = _mix(key[row] + step.astype(np.uint64) * ODD[0])
            code = np.where(least < best, found, code)
            best = np.minimum(least, best)
        return (code >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; two empty sets are alike, an empty and another one are not."""
    return float(len(a) == len(b) and (not len(a) or (a == b).mean()))


def fingerprint_column(text: Column, samples: int = SAMPLES) -> Column:
    """Fingerprint of each whole text (null: empty) as little-endian 16-bit codes."""
    @F.pandas_udf("binary")
    def make(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sampler = Sampler(samples)
        for part in parts:
            yield pd.Series([sampler.fingerprint(terms(t or "")).astype("<u2").tobytes() for t in part], dtype=object)

    return make(text)


def _ranges(rows: DataFrame) -> list[tuple[int, int]]:
    """First (id, hash) of each range of about PART_CHARS characters, in order; their number depends on size, not what they hold."""
    sizes = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = min(PARTS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (sizes[1] or 0) // PART_CHARS + 1))
    step = max(1, -(-sizes[0] // parts))
    first = numbered(rows.select("doc_id", "hash"), ["doc_id", "hash"]).where(F.col("pos") % step == 0).select("doc_id", "hash")
    return sorted({_key(r["doc_id"], r["hash"]) for r in first.collect()})


def _key(doc_id, text_hash) -> tuple[int, int]:
    return (-1 << 63) - 1 if doc_id is None else int(doc_id), int(text_hash)


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """RESULT columns: fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n / 2) code points replaced by as many (or all) first ones of the next document, in
    ascending doc_id; after the last comes the first. Rows with a null id come first, rows that share an id in an order
    fixed by their text; repeated rows follow each other. A null text is an empty one; texts without a word have an empty
    fingerprint, alike to one another only. Other columns are not read. An empty table gives no rows.

    Texts are shuffled once, by range of ids; the first row of a range travels to the range before it as well.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    firsts = _ranges(rows)
    if not firsts:
        return spark.createDataFrame([], RESULT)
    held = spark.sparkContext.broadcast(firsts)

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """Range of a row; for a range's first row also the range before it, as its negative minus 1."""
        bounds, out = held.value, []
        for i, h in zip(ids, hashes):
            key = _key(i, h)
            at = bisect_right(bounds, key) - 1
            out.append([at, -((at - 1) % len(bounds)) - 1] if bounds[at] == key else [at])
        return pd.Series(out)

    dealt = rows.select("doc_id", "text", "hash", F.explode(places(F.col("doc_id").cast("string"), "hash")).alias("place"))
    dealt = dealt.select("doc_id", F.col("doc_id").cast("string").alias("id"), "text", "hash", (F.col("place") < 0).alias("guest"), F.when(F.col("place") < 0, -F.col("place") - 1).otherwise(F.col("place")).alias("part"))
    dealt = dealt.repartition(len(firsts), "part").sortWithinPartitions("part", "guest", "doc_id", "hash").select("id", "text", "guest", "part")
    return dealt.mapInPandas(_chain(samples), RESULT.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def _chain(samples: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, last = Sampler(samples), None  # last: a row (part, id, text, fingerprint) that waits for the next one
        for part in parts:
            out = []
            for i, text, guest, where in zip(part["id"], part["text"], part["guest"], part["part"]):
                if guest and (last is None or last[0] != where):
                    continue  # a repeated first row: the range's last row has met one
                own = sampler.fingerprint(terms(text))
                if last is not None and last[0] == where:
                    out.append(_compared(sampler, last, text, own))
                last = None if guest else (where, i, text, own)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
    return run


def _compared(sampler: Sampler, row: tuple, following: str, next_print: np.ndarray) -> tuple:
    _, i, text, own = row
    half = len(text) // 2
    edited = text[:len(text) - half] + following[:half]
    other = sampler.fingerprint(terms(edited))
    codes = lambda x: x.astype("<u2").tobytes()
    return (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), codes(own), codes(other), likeness(own, other), likeness(own, next_print))
