"""Work queues and throttles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.base import any_of, at, col, text, ts
from . import core as C


def enrich_queue(jobs: DataFrame, sources: DataFrame, max_fail: int = 3) -> DataFrame:
    """Active postings without text and few failures, newest first per source (column turn)."""
    rows = jobs.where((F.col("status") == "active") & F.col("summary").isNull() & (F.col("enrich_fail_count") < max_fail))
    rows = rows.join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    return C.numbered(rows, ["source_id"], [F.col("first_seen_at").desc(), F.col("id")], "turn")


def liveness_queue(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """All active postings of the sources, never checked first."""
    rows = jobs.where("status = 'active'").join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    return C.numbered(rows, ["source_id"], [F.col("enrich_checked_at").asc_nulls_first(), F.col("id")], "turn")


def interleaved(queue: DataFrame, listed: DataFrame) -> DataFrame:
    """Rounds over the sources of a queue, list companies first inside each round."""
    l = listed.select("company", F.lit(0).alias("_l")).distinct()
    return queue.join(l, "company", "left").withColumn("turn_priority", F.coalesce("_l", F.lit(1))).drop("_l")


def fair_queue(jobs: DataFrame, n_sources: int, want: int) -> DataFrame:
    """Equal share per source, the longest unchecked first, then the wanted number over all."""
    quota = max(1, -(-want // max(1, n_sources)))
    return C.fair_quota(jobs.where("status = 'active'"), "source_id", [F.col("enrich_checked_at").asc_nulls_first(), F.col("id")], quota, want)


def new_first_queue(jobs: DataFrame, now, want: int, hours: int = 48) -> DataFrame:
    rows = jobs.where((F.col("status") == "active") & F.col("enrich_checked_at").isNull() & (F.col("first_seen_at") >= at(now) - F.expr(f"interval {hours} hours")))
    return rows.orderBy(F.col("first_seen_at").desc(), "id").limit(want)


def audit_queue(must: DataFrame, regular: DataFrame, order, limit: int, must_only: bool = False) -> DataFrame:
    """Half of the places for list companies, the others in turn, nothing twice."""
    quota = limit if must_only else limit // 2
    head = must.orderBy(*order).limit(quota).withColumn("_part", F.lit(0))
    if must_only:
        return head.drop("_part")
    rest = regular.join(head.select("id"), "id", "left_anti").withColumn("_part", F.lit(1))
    return head.unionByName(rest).orderBy("_part", *order).limit(limit).drop("_part")


def gap_queue(rows: DataFrame, targets, now, cap: int = 20) -> DataFrame:
    """Due list companies: wanted industries, wanted by users, worst covered industry, name."""
    due = (F.coalesce("state", F.lit("unknown")) == "unknown") | (F.col("next_retry_at") <= at(now))
    hit = F.arrays_overlap("industries", F.array(*[F.lit(t) for t in targets])) if targets else F.lit(False)
    return rows.where(due).orderBy((~hit).cast("int"), (~F.col("wanted")).cast("int"), F.coalesce("coverage", F.lit(1.0)), F.lower("company")).limit(cap)


def plan_targets(candidates: DataFrame, existing: DataFrame, cap: int, seed: int, quotas=(0.25, 0.5, 0.25)) -> DataFrame:
    """New companies by tier quotas in a seeded order; places a tier leaves go to the next rows."""
    new = C.missing_from(candidates, existing, "company")
    order = [F.xxhash64(F.col("company"), F.lit(seed)), F.col("company")]
    ranked = C.numbered(new, ["tier"], order, "_rn")
    share = F.get(F.array(*[F.lit(int(cap * q)) for q in quotas]), F.col("tier").cast("int"))
    return (ranked.withColumn("_over", (F.col("_rn") > share).cast("int")).orderBy("_over", "tier", "_rn").limit(cap).drop("_rn", "_over"))


def insight_queue(profiles: DataFrame, now, kind: str) -> DataFrame:
    """Profiles whose enrichment is missing or old: 90 days, or 180 with the youngest companies first."""
    column, days = ("t2_enriched_at", 90) if kind == "t2" else ("t3_enriched_at", 180)
    due = F.col(column).isNull() | (F.col(column) < at(now) - F.expr(f"interval {days} days"))
    order = [F.col(column).asc_nulls_first(), F.col("id")] if kind == "t2" else [F.col("founded_year").desc_nulls_last(), F.col(column).asc_nulls_first(), F.col("id")]
    return profiles.where(due).orderBy(*order)


def browser_queue(rows: DataFrame, now, cap: int, terminal=("covered", "login_wall", "no_stable_jd")) -> DataFrame:
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= at(now))
    return rows.where((F.coalesce("platform", F.lit("unknown")) == "unknown") & ~F.col("state").isin(list(terminal)) & due).orderBy("last_attempt_at", "company").limit(cap)


def throttle(runs: DataFrame, now, cooldown: int = 10, stale: int = 20) -> DataFrame:
    """reuse / cooldown / dispatch per user from the recent runs."""
    n = F.unix_timestamp(at(now))
    t = F.unix_timestamp(F.coalesce("created_at", "started_at"))
    live = F.col("status").isin("queued", "running") & (n - t < stale * 60)
    g = runs.where(t.isNotNull()).groupBy("user_id").agg(
        F.max_by(F.when(live, F.col("id")), F.when(live, F.struct(t, F.col("id")))).alias("live_run"), F.max(t).alias("last"))
    wait = cooldown * 60 - (n - F.col("last"))
    return g.select("user_id", F.when(F.col("live_run").isNotNull(), "reuse").when(wait > 0, "cooldown").otherwise("dispatch").alias("action"),
                    "live_run", F.when(F.col("live_run").isNull() & (wait > 0), F.greatest(F.lit(1), wait)).cast("int").alias("retry_after"))


def insight_throttle(runs: DataFrame, now, cooldown_hours: int = 6, hourly_cap: int = 5) -> DataFrame:
    """Same per company with a cap on all runs of the last hour."""
    n = F.unix_timestamp(at(now))
    t = F.unix_timestamp("created_at")
    live = F.col("status").isin("queued", "running") & (n - t < cooldown_hours * 3600)
    g = runs.groupBy("company_key").agg(F.bool_or(live).alias("live"), F.max(t).alias("last"))
    hourly = runs.where(t >= n - 3600).agg(F.count("*").alias("hourly"))
    j = g.withColumn("_k", F.lit(1)).join(hourly.withColumn("_k", F.lit(1)), "_k")
    return j.select("company_key", F.when(F.col("live"), "reuse").when(F.col("last") + cooldown_hours * 3600 > n, "cooldown")
                    .when(F.col("hourly") >= hourly_cap, "global_cap").otherwise("dispatch").alias("action"))


def cache_hits(requests: DataFrame, runs: DataFrame, minutes: int = 45) -> DataFrame:
    """Latest earlier run of the same request (nulls equal) inside the look-back."""
    return C.as_of_within(requests, runs, ["user_id", "mode"], "asked_at", "created_at", minutes, "request_id", "run_id")
