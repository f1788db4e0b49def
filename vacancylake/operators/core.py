"""Joins, windows and set operations the jobs are composed of.

No operator broadcasts by hint: Spark broadcasts a side when its measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides on
the key, with adaptive skew splitting.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.base import all_of, at, col, text


# --- windows ---------------------------------------------------------------

def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order. The order must end in a unique column."""
    return top_n_per(df, keys, order, 1)


def top_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n) -> DataFrame:
    """First n rows per key; Spark limits each group before the shuffle when n is a constant."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def weighted_round_robin(df: DataFrame, owner: Sequence[str], tier: str, order: Sequence[Column],
                         weight: Column, budget: int) -> DataFrame:
    """Draw from tiers in turn, ``weight`` rows of a tier per round, until the budget is full.

    An exhausted tier leaves its share to the others.
    """
    head = top_n_per(df.withColumn("_w", weight.cast("double")), [*owner, tier], order, budget)
    ranked = numbered(head, [*owner, tier], order, "tier_rn")
    return top_n_per(ranked, owner, [F.col("tier_rn") / F.col("_w"), F.col(tier)], budget).drop("_w")


def interleave(df: DataFrame, group: str, order: Sequence[Column], priority: Column | None = None,
               within: Sequence[str] = ()) -> DataFrame:
    """One row of every group, then the next one of every group: column ``turn`` gives the round."""
    out = numbered(df, [*within, group], order, "turn")
    return out.withColumn("turn_priority", priority if priority is not None else F.lit(0))


def spread_then_fill(df: DataFrame, owner: Sequence[str], group: Sequence[str], order: Sequence[Column], cap: Column | int,
                     limit: Column | int) -> DataFrame:
    """At most ``cap`` rows per group first; the rest only fills places left under ``limit``."""
    capped = df.withColumn("_over", (F.row_number().over(Window.partitionBy(*owner, *group).orderBy(*order)) > cap).cast("int"))
    if not owner:
        return capped.orderBy("_over", *order).limit(limit).drop("_over")
    w = Window.partitionBy(*owner).orderBy(F.col("_over"), *order)
    return capped.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= limit).drop("_over")


def fair_quota(df: DataFrame, group: str, order: Sequence[Column], quota: Column | int, limit: int | None) -> DataFrame:
    """Up to ``quota`` rows per group, then a limit over all in the same order."""
    out = top_n_per(df, [group], order, quota)
    return out.orderBy(*order).limit(limit) if limit is not None else out


def shard(df: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """Stable k-th of n parts of a queue, by hash of the key."""
    return df.where(F.pmod(F.xxhash64(col(key).cast("string")), F.lit(n)) == k)


# --- joins -----------------------------------------------------------------

def missing_from(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def by_keys(df: DataFrame, keys: DataFrame, key: str, active_only: bool = False) -> DataFrame:
    rows = df.where(F.col("status") == "active") if active_only else df
    return rows.join(keys.select(key).distinct(), key, "left_semi")


#: tasks that the rows of one key are dealt to where a join has few keys
SLOTS = 16


def spread_join(many: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of few values: the rows of ``many`` are dealt to SLOTS parts of a key, ``few`` goes to each part.

    ``few`` is copied SLOTS times, so it should be the side of fewer rows. Both sides keep their order of columns: keys,
    ``many``, ``few``.
    """
    m = many.withColumn("_slot", F.pmod(F.xxhash64(*many.columns), F.lit(SLOTS)).cast("int"))
    f = few.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return m.join(f, [*keys, "_slot"]).drop("_slot")


GRAM = 3


def _grams(c: Column) -> Column:
    """All substrings of one to three characters, without repeats."""
    n = F.length(c)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))) \
        .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def needle_of(pattern) -> Column:
    """Longest literal run of an ILIKE pattern, lower case."""
    runs = F.split(F.lower(text(pattern)), "[%_]")
    return F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]


def contains_join(texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str,
                  condition: Column | None = None) -> DataFrame:
    """All (text, needle) pairs where the text contains the needle, any case, as an equi-join.

    Each needle is looked up by the rarest of its three-character runs among the texts
    (shorter needles by themselves) and then verified, so needles that share a beginning
    do not meet on one key. The text side should hold distinct texts. Pass ``condition``
    for a test that is stronger than containment. Empty needles match nothing.
    """
    t = texts.withColumn("_gram", F.explode(_grams(F.lower(text(text_col)))))
    n = needles.withColumn("_needle", F.lower(text(needle_col))).where(F.col("_needle") != "")
    size = F.least(F.length("_needle"), F.lit(GRAM))
    runs = F.transform(F.sequence(F.lit(1), F.length("_needle") - size + 1), lambda i: F.substring(F.col("_needle"), i, size))
    wanted = n.select("_needle").distinct().select("_needle", F.explode(F.array_distinct(runs)).alias("_gram"))
    often = t.select("_gram").join(wanted.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_often"))
    rare = wanted.join(often, "_gram", "left").groupBy("_needle").agg(F.min_by("_gram", F.struct(F.coalesce("_often", F.lit(0)), "_gram")).alias("_gram"))
    pairs = t.join(n.join(rare, "_needle"), "_gram").where(F.lower(text(text_col)).contains(F.col("_needle")))
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.drop("_gram", "_needle")


def match_patterns(patterns: DataFrame, pattern_col: str, texts: DataFrame, text_col: str) -> DataFrame:
    """Pairs with ``text ilike pattern``, by the longest literal run of the pattern.

    Distinct patterns meet distinct texts; rows of equal patterns or texts are handed their pairs at the end.
    """
    p = patterns.select(pattern_col).distinct().withColumn("_lit", needle_of(pattern_col))
    names = texts.select(text_col).distinct()
    narrow = contains_join(names, text_col, p, "_lit", F.expr(f"{text_col} ilike {pattern_col}")).select(text_col, pattern_col)
    # a pattern of wildcards only has nothing to look up: "_" runs are met by length, "%" meets every text
    bare = p.where((F.col("_lit") == "") & (text(pattern_col) != "")).drop("_lit")
    bare = bare.withColumn("_key", F.when(F.col(pattern_col).contains("%"), -1).otherwise(F.length(pattern_col)))
    keyed = names.withColumn("_key", F.explode(F.array(F.length(text(text_col)), F.lit(-1))))
    wide = keyed.join(bare, "_key").where(F.expr(f"{text_col} ilike {pattern_col}"))
    pairs = narrow.union(wide.select(text_col, pattern_col))
    found = texts.join(pairs, text_col)
    if patterns.columns != [pattern_col]:
        found = spread_join(found, patterns, [pattern_col])
    return found.select(*texts.columns, *patterns.columns)


def assign_first(texts: DataFrame, text_col: str, dim: DataFrame, needle_col: str, position: str) -> DataFrame:
    """Each text with the first dimension row, by position, whose needle it contains.

    Of rows with one needle only the first can win, so the others leave before the texts are met.
    """
    first = latest_per_key(dim.withColumn("_folded", F.lower(text(needle_col))), ["_folded"], [F.col(position)]).drop("_folded")
    return latest_per_key(contains_join(texts, text_col, first, needle_col), [text_col], [F.col(position)])


def semi_by_any(left: DataFrame, right: DataFrame, keys: Sequence[Sequence[str]], id_col: str) -> DataFrame:
    """Rows of left that meet a row of right on any one of several key sets (no OR join)."""
    hits = None
    for ks in keys:
        # SQL equality: rows with a null in the key never meet
        part = left.join(right.select(*ks).distinct(), list(ks), "left_semi").select(id_col)
        hits = part if hits is None else hits.union(part)
    return left.join(hits.distinct(), id_col, "left_semi")


def add_dimension(df: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: Sequence[str]) -> DataFrame:
    """Left join of a few columns of a dimension with unique keys."""
    d = dim.select(F.col(dim_key).alias(key), *columns)
    return df.join(d, key, "left")


def overlapping(claims: DataFrame, keys: Sequence[str], start: str, end: str, id_col: str) -> DataFrame:
    """Pairs of different rows of one key whose closed whole-number ranges overlap.

    Ranges are looked up by the points they cover (months: at most 12), and a pair is
    kept only at the first point both cover, so it appears once.
    """
    a = claims.select(*keys, *[F.col(c).alias(f"{c}_a") for c in (id_col, start, end)])
    b = claims.select(*keys, *[F.col(c).alias(f"{c}_b") for c in (id_col, start, end)])
    ap = a.withColumn("_p", F.explode(F.sequence(F.col(f"{start}_a"), F.col(f"{end}_a"))))
    bp = b.withColumn("_p", F.explode(F.sequence(F.col(f"{start}_b"), F.col(f"{end}_b"))))
    return (ap.join(bp, [*keys, "_p"])
            .where((F.col("_p") == F.greatest(f"{start}_a", f"{start}_b")) & (F.col(f"{id_col}_a") != F.col(f"{id_col}_b")))
            .drop("_p"))


def as_of_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
                 minutes: int, left_id: str, right_id: str) -> DataFrame:
    """Latest right row of equal (null-safe) keys in the ``minutes`` before each left row.

    Times are cut in buckets of that length; a match lies in the same or the previous one.
    """
    size = minutes * 60
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c)) / size)
    l = left.withColumn("_b", F.explode(F.array(bucket(left_ts), bucket(left_ts) - 1)))
    r = right.withColumn("_b", bucket(right_ts))
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    cond = all_of([l["_b"] == r["_b"], *[l[k].eqNullSafe(r[f"_r_{k}"]) for k in keys],
                   r[right_ts] <= l[left_ts], r[right_ts] >= l[left_ts] - F.expr(f"interval {minutes} minutes")])
    out = l.join(r, cond).drop("_b", *[f"_r_{k}" for k in keys])
    return latest_per_key(out, [left_id], [F.col(right_ts).desc(), F.col(right_id).desc()])


# --- sets ------------------------------------------------------------------

def union_first(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Union in the given order, one row per key: the earliest part wins."""
    tagged = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        tagged = p if tagged is None else tagged.unionByName(p)
    return latest_per_key(tagged, keys, [F.col("_part"), *order]).drop("_part")


def top_n_frequent(df: DataFrame, owner: Sequence[str], key: str, n: int) -> DataFrame:
    """Most frequent values per owner; equal counts by value."""
    counts = df.where(F.col(key).isNotNull()).groupBy(*owner, key).agg(F.count("*").alias("n"))
    return numbered(counts, owner, [F.col("n").desc(), F.col(key)], "rank").where(F.col("rank") <= n)


def missing_count(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [F.count_if(text(c) == "").alias(f"{c}_missing") for c in columns]
