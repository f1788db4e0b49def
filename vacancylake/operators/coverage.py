"""Company aggregates and coverage of watch lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import company as CO
from ..functions.base import any_of, at, text
from ..functions.text import is_valid_active
from ..sources.tables import checkpointed
from . import core as C


def pct(part, whole) -> Column:
    """Whole percent of a coverage, at most 100, null for an unknown or empty whole."""
    p, w = F.col(part).cast("decimal(20,0)"), F.col(whole)
    return F.when(w > 0, F.round(F.least(F.lit(100).cast("decimal(38,10)"), p * 100 / w), 0).cast("int"))


def active_measures(now) -> list[Column]:
    n = at(now)
    healthy = F.length(F.trim(F.col("summary"))) >= 60
    return [F.count("*").alias("active_total"), F.count_if(healthy).alias("healthy"),
            F.count_if(F.col("first_seen_at") > n - F.expr("interval 7 days")).alias("new_7d"),
            F.count_if(F.col("enrich_checked_at") > n - F.expr("interval 72 hours")).alias("checked_72h")]


MEASURES = ["active_total", "healthy", "new_7d", "checked_72h"]


def company_aggregates(jobs: DataFrame, now) -> DataFrame:
    return jobs.where("status = 'active'").groupBy("company").agg(*active_measures(now))


def posting_flags(jobs: DataFrame, now) -> DataFrame:
    """Active postings as company, title and 0/1 measures: what joins need, without the texts."""
    n = at(now)
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return jobs.where("status = 'active' and company is not null").select(
        "company", "title", F.lit(1).cast("long").alias("active_total"), one(F.length(F.trim(F.col("summary"))) >= 60).alias("healthy"),
        one(F.col("first_seen_at") > n - F.expr("interval 7 days")).alias("new_7d"),
        one(F.col("enrich_checked_at") > n - F.expr("interval 72 hours")).alias("checked_72h"))


def brand_rollup(jobs: DataFrame, dim: DataFrame, now) -> DataFrame:
    """Counts of a brand's postings inside its parent's portal, per list row (pos).

    Postings are counted once per company and token list. A rule takes the companies of its parent's pattern less those that
    also meet its own pattern, so it never meets companies one by one: both sums are made per distinct pattern pair. Only list
    rows (pos) with several rules for one token list look at their companies, as these may share some.
    """
    rules = dim.where("parent_pattern is not null and pattern is not null and size(brand_tokens) > 0").select("pos", "pattern", "parent_pattern", "brand_tokens").distinct()
    rules = rules.withColumn("_rules", F.count("*").over(Window.partitionBy("pos", "brand_tokens")))
    single, several = rules.where("_rules = 1").drop("_rules"), rules.where("_rules > 1").drop("_rules")
    flags = posting_flags(jobs, now).groupBy("company", "title").agg(*[F.sum(m).alias(m) for m in MEASURES])
    names = flags.select("company").distinct()
    lists = rules.select("brand_tokens").distinct()
    named = flags.join(lists, F.exists("brand_tokens", lambda b: F.lower(F.col("title")).contains(F.lower(b))))
    sums = lambda: [F.sum(m).alias(m) for m in MEASURES]
    named = checkpointed(named.groupBy("company", "brand_tokens").agg(*sums()))
    inside = C.match_patterns(rules.select("parent_pattern").distinct(), "parent_pattern", names, "company")
    every = inside.join(named, "company").groupBy("parent_pattern", "brand_tokens").agg(*sums())
    meant = C.match_patterns(rules.select("pattern").distinct(), "pattern", names, "company")
    pairs = rules.select("pattern", "parent_pattern").distinct()
    both = meant.join(pairs, "pattern").where("company ilike parent_pattern").join(named, "company")
    both = both.groupBy("pattern", "parent_pattern", "brand_tokens").agg(*[F.sum(m).alias("_" + m) for m in MEASURES])
    left = single.join(every, ["parent_pattern", "brand_tokens"]).join(both, ["pattern", "parent_pattern", "brand_tokens"], "left")
    left = left.select("pos", *[(F.col(m) - F.coalesce("_" + m, F.lit(0))).alias(m) for m in MEASURES]).where("active_total > 0")
    shared = several.join(inside, "parent_pattern").where("not (company ilike pattern)").select("company", "pos", "brand_tokens").distinct()
    shared = shared.join(named, ["company", "brand_tokens"]).select("pos", *MEASURES)
    return left.union(shared).groupBy("pos").agg(*sums())


def must_apply_coverage(jobs: DataFrame, dim: DataFrame, now, min_parent: int = 3) -> DataFrame:
    """Per list company: direct counts plus a parent-portal rollup once it holds enough healthy postings."""
    per_company = company_aggregates(jobs, now).where("company is not null")
    matched = C.match_patterns(dim.select("pattern").distinct(), "pattern", per_company, "company")
    direct = matched.groupBy("pattern").agg(*[F.sum(m).alias(m) for m in MEASURES])
    rollup = brand_rollup(jobs, dim, now).where(F.col("healthy") >= min_parent)
    rollup = rollup.select("pos", *[F.col(m).alias("p_" + m) for m in MEASURES])
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (dim.select("pos", "name", "pattern").join(direct, "pattern", "left").join(rollup, "pos", "left")
            .select("pos", "name", "pattern", *[(z(m) + z("p_" + m)).alias(m) for m in MEASURES],
                    z("healthy").alias("direct_healthy"), z("p_healthy").alias("parent_healthy"),
                    (z("p_healthy") > 0).alias("via_parent")))


def latest_with_source(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Latest run of every enabled source."""
    latest = C.latest_per_key(runs, ["source_id"], [F.col("started_at").desc_nulls_last(), F.col("id").desc()])
    s = sources.where("enabled").select(F.col("id").alias("source_id"), "company",
                                        F.coalesce("adapter_name", F.lit("unknown")).alias("adapter"))
    return latest.join(s, "source_id").select(
        "source_id", "company", "adapter", "reported_total", F.coalesce("jobs_found", F.lit(0)).alias("fetched"),
        F.coalesce("finished_at", "started_at").alias("last_run_at"))


def coverage_scored(runs: DataFrame, sources: DataFrame) -> DataFrame:
    return latest_with_source(runs, sources).withColumn("coverage_pct", pct("fetched", "reported_total"))


def coverage_snapshot(runs: DataFrame, sources: DataFrame) -> DataFrame:
    return coverage_scored(runs, sources).agg(
        F.count_if(F.col("reported_total").isNotNull()).alias("measurable"),
        F.count_if(F.col("reported_total").isNull()).alias("blind"),
        F.round(F.avg(F.when(F.col("reported_total") > 0, F.col("coverage_pct"))).cast("decimal(20,10)"), 0).cast("int").alias("avg_coverage_pct"),
        F.count_if((F.col("reported_total") > 0) & (F.col("coverage_pct") < 80)).alias("under_count"))


def coverage_worst(runs: DataFrame, sources: DataFrame, n: int = 40) -> DataFrame:
    return (coverage_scored(runs, sources).where("reported_total > 0 and coverage_pct < 80")
            .orderBy("coverage_pct", "company", "source_id").limit(n))


def list_fetch_coverage(patterns: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest runs of all sources behind each list pattern, summed; unknown totals stay null, never 0."""
    s = sources.where("enabled").select(F.col("id").alias("source_id"), "company").distinct()
    # list rows of one pattern share its sources: matched and summed once per distinct pattern
    matched = C.match_patterns(patterns.select("pattern").distinct(), "pattern", s, "company").select("pattern", "source_id").distinct()
    latest = C.latest_per_key(runs, ["source_id"], [F.col("started_at").desc_nulls_last(), F.col("id").desc()])
    joined = matched.join(latest.select("source_id", "reported_total", F.coalesce("jobs_found", F.lit(0)).alias("fetched"),
                                        F.coalesce("finished_at", "started_at").alias("last_run_at")), "source_id", "left")
    totals = joined.groupBy("pattern").agg(
        F.sum("reported_total").cast("int").alias("reported_total"), F.coalesce(F.sum("fetched"), F.lit(0)).cast("int").alias("fetched"),
        F.max("last_run_at").alias("last_run_at"))
    # a row without pos is no list entry and takes no totals
    entry = patterns.select("pos", "pattern").withColumn("_key", F.when(F.col("pos").isNotNull(), F.col("pattern")))
    out = entry.join(totals.withColumnRenamed("pattern", "_key"), "_key", "left").drop("_key").withColumn("fetched", F.coalesce("fetched", F.lit(0)))
    return out.withColumn("measurable", F.col("reported_total").isNotNull()).withColumn("coverage_pct", pct("fetched", "reported_total"))


def coverage_by_industry(coverage: DataFrame, dim: DataFrame) -> DataFrame:
    """Coverage per industry; ``dim`` gives the industries of each pattern."""
    rows = dim.select("pattern", F.explode("industries").alias("industry")).join(coverage, "pattern")
    return rows.groupBy("industry").agg(
        F.count("*").alias("total"), F.count_if("measurable").alias("measurable"), F.count_if(~F.col("measurable")).alias("blind"),
        F.count_if(F.col("coverage_pct") >= 90).alias("fully_fetched"),
        F.floor(F.avg("coverage_pct") + 0.5).cast("int").alias("avg_pct"))


def industry_coverage(rows: DataFrame) -> DataFrame:
    """Share of healthy companies per industry."""
    r = rows.select(F.explode("industries").alias("industry"), (F.col("state") == "healthy").alias("ok"))
    return r.groupBy("industry").agg(F.count("*").alias("total"), F.count_if("ok").alias("healthy"),
                                     (F.count_if("ok") / F.count("*")).alias("ratio"))


def channel_coverage(sources: DataFrame) -> DataFrame:
    """Channels per segment and industry with segment totals and a grand total."""
    return sources.rollup("segment", "industry").agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"))


def source_flags(dim: DataFrame, sources: DataFrame) -> DataFrame:
    """Per list entry: any source, an enabled one, one with a campus board."""
    flags = sources.groupBy("company").agg(F.bool_or("enabled").alias("has_enabled"), F.bool_or(F.col("enabled") & F.col("board").isin("campus", "mixed")).alias("has_campus"))
    either = [F.bool_or(c).alias(c) for c in ("has_enabled", "has_campus")]
    # per distinct pattern first: list rows of one pattern share its companies
    hit = C.match_patterns(dim.select("pattern").distinct(), "pattern", flags, "company").groupBy("pattern").agg(*either)
    g = dim.select("pos", "pattern").distinct().join(hit, "pattern").groupBy("pos").agg(F.lit(True).alias("has_any"), *either)
    f = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return dim.select("pos", "name").join(g, "pos", "left").select("pos", "name", f("has_any"), f("has_enabled"), f("has_campus"))


def link_by_company_key(wanted: DataFrame, sources: DataFrame, rule: str = "cover") -> DataFrame:
    """Sorted ids of the enabled sources whose folded company name equals the wanted one."""
    s = sources.where("enabled").select(CO.company_key("company", rule).alias("_k"), F.col("id").alias("source_id"))
    w = wanted.withColumn("_k", CO.company_key("company", rule))
    ids = s.where("_k <> ''").groupBy("_k").agg(F.array_sort(F.collect_set("source_id")).alias("matched_source_ids"))
    return w.join(ids, "_k", "left").drop("_k")


def watch_queue(requests: DataFrame) -> DataFrame:
    """One row per wanted company: who asks, since when, latest status first by urgency."""
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "in_progress", 1).when(F.col("status") == "covered", 2).otherwise(3)
    g = requests.groupBy("normalized").agg(
        F.countDistinct("user_id").alias("requesters"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        F.max_by("status", F.struct("created_at", "id")).alias("status"), F.min_by("company", F.struct("created_at", "id")).alias("company"))
    return g.withColumn("rank", rank)


# fixed values: states that new evidence decides; any other earlier state is the outcome of a failed attempt and stays
EVIDENCE_STATES = ["", "healthy", "thin_only", "no_active_jobs"]


def gap_census(jobs: DataFrame, sources: DataFrame, dim: DataFrame, previous: DataFrame, now) -> DataFrame:
    """State of every list company: healthy, thin_only, no_active_jobs, an earlier failure state, or unknown."""
    cov = must_apply_coverage(jobs, dim, now)
    flags = source_flags(dim, sources)
    failed = F.when(~F.col("state").isin(EVIDENCE_STATES), F.col("state"))
    prev = previous.select("pattern", failed.alias("prev_state"), "attempts")
    return (cov.join(flags.drop("name"), "pos").join(prev, "pattern", "left")
            .withColumn("state", F.when(F.col("healthy") > 0, "healthy").when(F.col("active_total") > 0, "thin_only")
                        .when(F.col("has_enabled"), "no_active_jobs").otherwise(F.coalesce("prev_state", F.lit("unknown"))))
            .select("pos", "name", "pattern", "state", "active_total", "healthy", "direct_healthy", "parent_healthy", "has_any",
                    F.coalesce("attempts", F.lit(0)).alias("attempts")))


#: fixed values: states whose first retry is due at once
DUE_STATES = ["thin_only", "no_active_jobs"]


def gap_ledger(jobs: DataFrame, sources: DataFrame, dim: DataFrame, previous: DataFrame, now, list_version: str) -> DataFrame:
    """The census as ledger rows: state, source, evidence and retry time of every list company, carried from the rows before.

    previous: (pattern, state, attempts, rounds_no_entry, source_id, official_entry_url, detected_platform, fail_reason,
    evidence (JSON object), last_attempt_at, next_retry_at), one row a pattern. New evidence replaces the keys it knows and
    leaves the others. A healthy company owes no reason and no retry; a thin or empty one without a retry time is due now.
    Evidence lists hold names and ids of one company only; they are built from distinct names, not from postings.
    """
    state = gap_census(jobs, sources, dim, previous, now)
    entries = dim.select("pos", "pattern").distinct()
    names = jobs.where("status = 'active' and company <> ''").select("company").distinct()
    told = C.match_patterns(dim.select("pattern").distinct(), "pattern", names, "company").groupBy("pattern").agg(F.array_sort(F.collect_set("company")).alias("_companies"))
    found = C.match_patterns(entries, "pattern", sources.select(F.col("id").cast("string").alias("source"), F.col("id").alias("_sid"), "company", "enabled"), "company")
    ids = found.groupBy("pos").agg(F.transform(F.array_sort(F.collect_set(F.struct("_sid", "source"))), lambda x: x["source"]).alias("_sources"), F.min(F.when(F.col("enabled"), F.col("_sid"))).cast("string").alias("_enabled"))
    carried = ["rounds_no_entry", "source_id", "official_entry_url", "detected_platform", "fail_reason", "evidence", "last_attempt_at", "next_retry_at"]
    rows = state.join(told, "pattern", "left").join(ids, "pos", "left").join(previous.select("pattern", *[F.col(c).alias("_" + c) for c in carried]), "pattern", "left")
    none = F.array().cast("array<string>")
    own = F.struct(F.lit(list_version).alias("list_version"), F.col("active_total").alias("active_jobs"), F.col("healthy").alias("healthy_jobs"), F.col("direct_healthy").alias("direct_healthy_jobs"),
                   F.col("parent_healthy").alias("parent_portal_healthy_jobs"), (F.col("parent_healthy") > 0).alias("covered_via_parent_portal"), F.coalesce("_companies", none).alias("matched_job_companies"), F.coalesce("_sources", none).alias("matched_source_ids"))
    fresh = F.from_json(F.to_json(own), "map<string,variant>")
    old = F.coalesce(F.from_json("_evidence", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    evidence = F.to_json(F.map_concat(F.map_filter(old, lambda k, _v: ~F.array_contains(F.map_keys(fresh), k)), fresh))
    healthy = F.col("state") == "healthy"
    due = F.col("state").isin(DUE_STATES) & F.col("_next_retry_at").isNull()
    return rows.select("pos", "name", "pattern", "state", F.coalesce("_enabled", F.when(F.col("state") != "unknown", F.col("_source_id").cast("string"))).alias("source_id"),
                       F.col("_official_entry_url").alias("official_entry_url"), F.col("_detected_platform").alias("detected_platform"), F.when(~healthy, F.col("_fail_reason")).alias("fail_reason"), evidence.alias("evidence"),
                       "attempts", F.coalesce("_rounds_no_entry", F.lit(0)).alias("rounds_no_entry"), F.col("_last_attempt_at").alias("last_attempt_at"),
                       F.when(healthy, None).when(due, at(now)).otherwise(F.col("_next_retry_at")).alias("next_retry_at"), at(now).alias("updated_at"))


def company_covered(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed names with ``covered``: equal, equal after folding, or attributable to an existing entity name.

    The attribution test runs only where the entity name holds the proposed one.
    """
    n = names.select("company").distinct().withColumn("key", CO.target_key("company"))
    e = existing.select(F.col("company").alias("existing")).distinct().withColumn("ekey", CO.target_key("existing"))
    equal = n.join(e, n["company"] == e["existing"]).select("company").union(
        n.where("key <> ''").join(e, n["key"] == e["ekey"]).select("company"))
    by_name = C.contains_join(e.select("existing"), "existing", n.select("company"), "company",
                              CO.name_matches("existing", "company")).select("company")
    by_key = C.contains_join(e.select("ekey").distinct(), "ekey", n.where("key <> ''").select("company", "key"), "key",
                             CO.name_matches("ekey", "key")).select("company")
    hits = equal.union(by_name).union(by_key).distinct().withColumn("covered", F.lit(True))
    return n.select("company").join(hits, "company", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def assign_owner(names: DataFrame, dim: DataFrame) -> DataFrame:
    """The first list entry whose needle a company name holds."""
    d = dim.select("pos", F.col("name").alias("owner"), F.replace(F.col("pattern"), F.lit("%"), F.lit("")).alias("needle"))
    return C.assign_first(names, "company", d, "needle", "pos").select("company", "owner", "pos")
