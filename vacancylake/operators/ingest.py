"""From landed postings to life-cycle-tracked rows.

Every step is one pass of column work, and the upsert is one shuffle on the
canonical URL; nothing is looked up row by row.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D, fixed as V, geo as G, text as T, tokens as K, urls as U
from ..functions.base import all_of, any_contains, any_of, at, col, quoted_alternation, text
from . import core as C

# fixed value: titles of navigation links that are never postings
NAVIGATION_TITLES = [
    "首页", "全部岗位", "岗位搜索", "社会招聘", "校园招聘", "实习生招聘", "博士招聘", "招聘帮助", "关于百度", "使用百度前必读",
    "发展在京东", "科技人才招聘", "了解海尔", "login", "faqs & support", "english", "deutsch", "español", "français", "nederlands",
    "portuguese", "čestina", "中文 (简体)", "中文 (繁体)", "日本語", "job search", "all jobs", "ai recommendations",
    "professional", "campus", "intern", "stay connected", "logout",
]


def reject_reason(title, jd_url, source_url, navigation_titles: Sequence[str] = NAVIGATION_TITLES) -> Column:
    """First reason a landed row is not a posting, null for a good one."""
    t, u, s = F.trim(text(title)), F.trim(text(jd_url)), F.trim(text(source_url))
    part = lambda url, p: F.regexp_extract(url, p, 1)
    scheme = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://"
    net, path_p, frag_p = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", r"#(.*)$"
    bare = lambda url: F.regexp_replace(part(url, path_p), "/+$", "")
    frag = lambda url: F.trim(part(url, frag_p))
    key = lambda url: F.concat(F.lower(part(url, net)), F.when(bare(url) == "", "/").otherwise(bare(url)),
                               F.when(frag(url) != "", F.concat(F.lit("#"), frag(url))).otherwise(""))
    query = part(u, r"^[^#?]*\?([^#]*)")
    has_job_key = F.exists(F.split(query, "&"), lambda p: F.regexp_replace(
        F.lower(F.substring_index(p, "=", 1)), "[^a-z0-9]", "").isin(V.JOB_QUERY_KEYS))
    own = F.when(bare(u) == "", "/").otherwise(bare(u))
    route = F.when((own == "/") & (frag(u) != ""), F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(frag(u), "^[#/]+", "")), "(?<=.)/+$", "")).otherwise(own)
    low = F.lower(route)
    squashed = [("".join(n.split())).lower() for n in navigation_titles]
    return (F.when(t == "", "missing title").when(u == "", "missing jd_url")
             .when(~F.lower(part(u, scheme)).isin("http", "https") | (part(u, net) == ""), "invalid jd_url")
             .when((key(u) == key(s)) & ~has_job_key, "jd_url equals source url")
             .when(F.lower(F.regexp_replace(t, r"\s+", "")).isin(squashed), "navigation title")
             .when(route == "/", "homepage is not a job detail")
             .when(any_contains(low, V.NAVIGATION_PATHS) | (low.contains("/searchjobs") & ~low.contains("/job/")), "navigation url"))


def quality_gate(raw: DataFrame, sources: DataFrame, navigation_titles: Sequence[str] = NAVIGATION_TITLES):
    """Split landed rows into (valid, rejects with a reason) by their source's address."""
    s = sources.select(F.col("id").alias("source_id"), F.col("source_url").alias("_source_url"))
    judged = raw.join(s, "source_id", "left").withColumn(
        "reject_reason", reject_reason("title", "jd_url", "_source_url", navigation_titles)).drop("_source_url")
    return judged.where("reject_reason is null").drop("reject_reason"), judged.where("reject_reason is not null")


def normalize_jobs(raw: DataFrame, sources: DataFrame, short: int = 500) -> DataFrame:
    """Landed rows as posting rows: cleaned text, derived place, type, class, dates and keys.

    Everything is read from the whole text; summary_short is a display form only.
    """
    s = sources.select(F.col("id").alias("source_id"), F.col("company").alias("_company"))
    r = raw.join(s, "source_id", "left")
    r = (r.withColumn("_body", F.col("summary")).withColumn("title", T.clean_title("title"))
          .withColumn("location", G.clean_location("location")).withColumn("summary", T.clean_summary("_body")))
    return r.select(
        "source_id", F.coalesce(F.nullif(text("company"), F.lit("")), "_company").alias("company"), "title", "location",
        G.country_code("location").alias("country_code"), G.job_scope("location").alias("job_scope"),
        F.when(T.is_recruitment_type("job_type"), F.col("job_type")).otherwise(F.coalesce(T.job_type("title", "summary"), "job_type")).alias("job_type"),
        T.grad_class("title", "job_type", "summary").alias("grad_class"), "summary", T.shorten("summary", short).alias("summary_short"),
        T.sponsorship("title", "summary").alias("sponsorship_signal"),
        T.strip_nul("jd_url").alias("jd_url"), U.canonical_url(T.strip_nul("jd_url")).alias("canonical_jd_url"), "apply_url",
        T.clean_salary("salary_text").alias("salary_text"), F.col("posted_at").try_cast("timestamp").alias("posted_at"),
        F.coalesce(F.nullif(text("experience"), F.lit("")), T.experience_text("_body")).alias("experience"),
        F.coalesce(F.nullif(text("education"), F.lit("")), T.education_level("_body")).alias("education"),
        F.coalesce(F.nullif(text("deadline"), F.lit("")), D.deadline_text("_body")).alias("deadline"),
        T.content_hash("title", "location", "summary").alias("content_hash"), F.lit("active").alias("status"),
        K.search_doc("title", F.coalesce(F.nullif(text("company"), F.lit("")), "_company"), "location", "job_type").alias("search_doc"),
        "arrived_seq")


# what an update may touch: the crawler writes all fields, the application fewer
CRAWLER = ["source_id", "company", "title", "location", "country_code", "job_scope", "job_type", "grad_class", "summary", "jd_url",
           "apply_url", "salary_text", "posted_at", "content_hash", "experience", "education", "deadline", "sponsorship_signal"]
APPLICATION = ["company", "title", "location", "country_code", "job_scope", "job_type", "grad_class", "summary", "apply_url",
               "salary_text", "posted_at", "content_hash", "sponsorship_signal"]
KEEP_IF_EMPTY = {"summary", "job_type", "experience", "education", "deadline", "salary_text"}
KEEP_IF_NULL = {"grad_class"}


def new_job_id(canonical) -> Column:
    """Deterministic id of a posting, so a retried job writes the same row."""
    return F.sha2(col(canonical), 256)


def upsert_jobs(existing: DataFrame, batch: DataFrame, now, columns: Sequence[str] = CRAWLER):
    """(jobs, events, counts) after merging a batch by canonical URL.

    The last arrival of a URL in the batch wins; an active stored row is preferred
    over others of the URL. Expired rows stay expired, removed rows come back. First
    sight and check stamps are never touched. Batch rows without a URL are left out: they name no posting.
    """
    n = at(now)
    fresh = C.latest_per_key(batch.where("trim(canonical_jd_url) <> ''"), ["canonical_jd_url"], [F.col("arrived_seq").desc()])
    new_cols = [c for c in CRAWLER if c in batch.columns]
    b = fresh.select("canonical_jd_url", *[F.col(c).alias("n_" + c) for c in new_cols], F.lit(True).alias("_new"))
    # mark the one stored row of each URL the batch may update; the others pass through
    from pyspark.sql import Window
    w = Window.partitionBy("canonical_jd_url").orderBy((F.col("status") == "active").desc(), F.col("id"))
    e = existing.withColumn("_target", F.row_number().over(w) == 1).withColumn("_old", F.lit(True))
    j = e.join(b, "canonical_jd_url", "full_outer")
    old = F.col("_old").isNotNull()
    hit = old & F.col("_new").isNotNull() & F.col("_target")
    created = ~old

    def value(c):
        if c not in new_cols:
            return F.col(c)
        new = F.col("n_" + c)
        if c in KEEP_IF_EMPTY:
            merged = F.coalesce(F.nullif(new, F.lit("")), F.col(c))
        elif c in KEEP_IF_NULL:
            merged = F.coalesce(new, F.col(c))
        else:
            merged = new
        update = merged if c in columns else F.col(c)
        return F.when(created, new).when(hit, update).otherwise(F.col(c))

    special = {
        "id": F.when(created, new_job_id("canonical_jd_url")).otherwise(F.col("id")),
        "status": F.when(created, "active").when(hit & (F.col("status") != "expired"), "active").otherwise(F.col("status")),
        "first_seen_at": F.when(created, n).otherwise(F.col("first_seen_at")),
        "last_seen_at": F.when(created | hit, n).otherwise(F.col("last_seen_at")),
        "enrich_fail_count": F.when(created, F.lit(0)).otherwise(F.col("enrich_fail_count")),
    }
    keep = [c for c in existing.columns]
    flags = [hit.alias("_hit"), created.alias("_created"), F.col("status").alias("_old_status"),
             (F.col("posted_at") if "posted_at" in keep else F.lit(None).cast("timestamp")).alias("_old_posted")]
    full = j.select(*[special.get(c, value(c)).alias(c) if c != "canonical_jd_url" else F.col(c) for c in keep],
                    *flags, F.col("n_posted_at").alias("_new_posted"), F.col("n_source_id").alias("_source"))
    day = F.date_format(n, "yyyy-MM-dd")
    ev = lambda cond, kind, dated=False: F.when(cond, F.struct(
        F.concat_ws(":", F.lit(kind), "id", *([day] if dated else [])).alias("event_key"), F.lit(kind).alias("event_type")))
    posted = F.col("_new_posted").isNotNull()
    events = full.where("_hit or _created").select("id", F.col("_source").alias("source_id"), F.explode(F.array_compact(F.array(
        ev(F.col("_created"), "FIRST_SEEN"),
        ev(posted & (F.col("_created") | F.col("_old_posted").isNull()), "OFFICIAL_POSTED"),
        ev(F.col("_hit") & (F.col("_old_status") == "removed"), "REAPPEARED", True)))).alias("e"))
    events = events.select("e.event_key", F.col("id").alias("job_id"), "source_id", "e.event_type", n.alias("occurred_at"))
    counts = full.agg(F.count_if("_created").alias("created"), F.count_if("_hit").alias("updated"))
    return full.select(*keep), events, counts


def append_events(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The new milestones only: one per key, keys already stored are left out."""
    return C.missing_from(new.dropDuplicates(["event_key"]), existing, "event_key")


def close_event(id_col, source, now) -> list[Column]:
    day = F.date_format(at(now), "yyyy-MM-dd")
    return [F.concat_ws(":", F.lit("CLOSED"), col(id_col), day).alias("event_key"), col(id_col).alias("job_id"),
            col(source).alias("source_id"), F.lit("CLOSED").alias("event_type"), at(now).alias("occurred_at")]


def absence_plan(jobs: DataFrame, runs: DataFrame, apply: bool = True, max_ratio: float = V.ABSENCE_MAX_RATIO,
                 floor: int = V.ABSENCE_MIN_ACTIVE) -> DataFrame:
    """Per completely fetched source: active, absent (not seen since the run began) and what to do."""
    r = runs.where("coverage_complete").select("source_id", "cutoff")
    g = jobs.where("status = 'active'").join(r, "source_id").groupBy("source_id", "cutoff").agg(
        F.count("*").alias("active"), F.count_if(F.col("last_seen_at") < F.col("cutoff")).alias("absent"))
    return g.withColumn("action", F.when(F.col("absent") == 0, "noop")
                        .when((F.col("active") >= floor) & (F.col("absent") > F.col("active") * max_ratio), "skip")
                        .otherwise("apply" if apply else "dry_run"))


def absence_sweep(jobs: DataFrame, runs: DataFrame, now, apply: bool = True):
    """(jobs, events): postings missing from a complete fetch expire, unless too many of a source would."""
    plan = absence_plan(jobs, runs, apply).where("action = 'apply'").select("source_id", "cutoff")
    j = jobs.join(plan, "source_id", "left")
    gone = (F.col("status") == "active") & F.col("cutoff").isNotNull() & (F.col("last_seen_at") < F.col("cutoff"))
    j = j.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    events = j.where("_gone").select(*close_event("id", "source_id", now))
    closed = F.col("confirmed_closed_at") if "confirmed_closed_at" in jobs.columns else F.lit(None).cast("timestamp")
    out = j.withColumn("confirmed_closed_at", F.when(F.col("_gone"), at(now)).otherwise(closed)).withColumn(
        "status", F.when(F.col("_gone"), "expired").otherwise(F.col("status"))).drop("_gone", "cutoff")
    return out, events


def apply_checks(jobs: DataFrame, checks: DataFrame, now):
    """(jobs with ``outcome``, events) after detail checks (id, closed, body): filled, alive, miss or expired."""
    c = checks.select("id", "closed", T.clean_summary("body").alias("_body"), F.lit(True).alias("_checked"))
    j = jobs.join(c, "id", "left")
    seen, has = F.col("_checked").isNotNull(), text("summary") != ""
    outcome = (F.when(~seen, F.lit(None)).when(F.col("closed"), "expired").when(has, "alive").when(text("_body") != "", "filled").otherwise("miss"))
    j = j.withColumn("outcome", outcome).withColumn("_was", F.col("status"))
    filled = F.col("outcome") == "filled"
    out = (j.withColumn("status", F.when(F.col("outcome") == "expired", "expired").otherwise(F.col("status")))
            .withColumn("summary", F.when(filled, F.col("_body")).otherwise(F.col("summary")))
            .withColumn("job_type", F.when(filled & (text("job_type") == ""), F.coalesce(T.job_type("title", "_body"), "job_type")).otherwise(F.col("job_type")))
            .withColumn("enrich_fail_count", F.when(F.col("outcome") == "miss", F.coalesce("enrich_fail_count", F.lit(0)) + 1).otherwise(F.col("enrich_fail_count")))
            .withColumn("enrich_checked_at", F.when(seen, at(now)).otherwise(F.col("enrich_checked_at"))))
    events = out.where("outcome = 'expired' and _was = 'active'").select(*close_event("id", "source_id", now))
    return out.drop("_body", "_checked", "closed", "_was"), events


def confirm_events(checked: DataFrame, now) -> DataFrame:
    """One confirmation per posting and day for postings found open."""
    day = F.date_format(at(now), "yyyy-MM-dd")
    return checked.where("outcome in ('alive', 'filled')").select(
        F.concat_ws(":", F.lit("CONFIRMED_OPEN"), "id", day).alias("event_key"), F.col("id").alias("job_id"), "source_id",
        F.lit("CONFIRMED_OPEN").alias("event_type"), at(now).alias("occurred_at"))


def expire_where(jobs: DataFrame, condition: Column) -> DataFrame:
    return jobs.withColumn("status", F.when((F.col("status") == "active") & condition, "expired").otherwise(F.col("status")))


def retire_expired(items: DataFrame, today) -> DataFrame:
    """Active claims past their date become retired; a missing date is first set to a year after the check."""
    until = F.coalesce("valid_until", F.add_months(F.to_date("last_verified_at"), 12))
    return items.withColumn("valid_until", until).withColumn(
        "status", F.when((F.col("status") == "active") & (F.col("valid_until") < F.to_date(at(today))), "retired").otherwise(F.col("status")))


def merge_companies(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """Rename company spellings (names: company -> canonical); a row that then duplicates one
    under the canonical name, by URL or by title and city, is dropped."""
    m = names.select("company", F.col("canonical").alias("_to"))
    tagged = jobs.join(m, "company", "left")
    foreign, own = tagged.where("_to is not null"), tagged.where("_to is null")
    keys = own.select(F.col("company").alias("_to"), "jd_url", "title", "location")
    dup = C.semi_by_any(foreign, keys, [["_to", "jd_url"], ["_to", "title", "location"]], "id")
    kept = C.missing_from(foreign, dup, "id").withColumn("company", F.col("_to"))
    return own.select(*jobs.columns).unionByName(kept.select(*jobs.columns))


def redirect_refs(child: DataFrame, dup_map: DataFrame, key: str = "source_id") -> DataFrame:
    """Point rows of duplicate sources at the one kept."""
    m = dup_map.select(F.col("source_id").alias(key), F.col("keep_id").alias("_keep"))
    return child.join(m, key, "left").withColumn(key, F.coalesce("_keep", key)).drop("_keep")


def apply_actions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One primary action per user and posting (the newest), views kept beside it."""
    every = existing.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    slot = F.when(F.col("action") == "viewed", "viewed").otherwise("primary")
    return C.latest_per_key(every.withColumn("_slot", slot), ["user_id", "job_id", "_slot"],
                            [F.col("created_at").desc(), F.col("_part").desc(), F.col("event_id").desc()]).drop("_part", "_slot")


def merge_gap_attempts(previous: DataFrame, results: DataFrame, now) -> DataFrame:
    """Ledger rows after a round: one more attempt, new state, evidence merged key by key."""
    kept = [c for c in ("last_attempt_at", "next_retry_at", "fail_reason") if c in previous.columns]
    p = previous.select("company", F.col("attempts").alias("_n"), F.col("evidence").alias("_e"), F.col("state").alias("_s"), *[F.col(c).alias(f"_{c}") for c in kept])
    r = results.select("company", "state", "evidence", *[c for c in kept if c != "last_attempt_at" and c in results.columns])
    j = p.join(r, "company", "full_outer")
    ran = F.col("state").isNotNull()
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    # newer keys win: old entries that the new evidence repeats are filtered first
    old = F.map_filter(F.coalesce("_e", empty), lambda k, _v: ~F.map_contains_key(F.coalesce("evidence", empty), k))
    return j.select("company", F.coalesce("state", "_s").alias("state"),
                    (F.coalesce("_n", F.lit(0)) + ran.cast("int")).alias("attempts"),
                    F.map_concat(old, F.coalesce("evidence", empty)).alias("evidence"),
                    F.when(ran, at(now)).otherwise(F.col("_last_attempt_at") if "last_attempt_at" in kept else F.lit(None)).alias("last_attempt_at"),
                    *[F.when(ran, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) if c in r.columns else F.col(f"_{c}").alias(c) for c in kept if c != "last_attempt_at"])


def sync_watch_requests(wanted: DataFrame, sources: DataFrame, existing: DataFrame):
    """(rows to store, rows to delete): wanted companies matched to sources, stale requests removed."""
    from ..functions import company as CO
    from .coverage import link_by_company_key
    w = wanted.withColumn("normalized", CO.cover_key("company")).where("normalized <> ''").dropDuplicates(["user_id", "normalized"])
    rows = link_by_company_key(w, sources)
    rows = rows.withColumn("status", F.when(F.size("matched_source_ids") > 0, "covered").otherwise("pending"))
    stale = existing.join(w.select("user_id", "normalized"), ["user_id", "normalized"], "left_anti")
    return rows, stale


def snapshot_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Counts that moved since the latest snapshot of their source, or have none."""
    last = previous.groupBy("source_id").agg(F.max_by("campus_count", F.struct("captured_at", "campus_count")).alias("prev_count"))
    j = current.join(last, "source_id", "left")
    return j.where("prev_count is null or prev_count <> campus_count")
