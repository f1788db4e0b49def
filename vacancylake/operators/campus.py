"""Campus recruiting: boards, surges, cycles, the campus page."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T, urls as U
from ..functions.base import any_of, at, col, hours_between, js_round, shanghai_date, text, ts
from . import core as C, coverage as CV, insights as IN

# fixed values
SEASON_MONTHS = [8, 9, 10, 11, 2, 3, 4]
RETRY_DAYS = {"robots_blocked": 3650, "unreachable": 30, "empty_board": 14, "duplicate_board": 3650, "no_healthy_jobs": 30}
SEASON_RETRY_DAYS = {"empty_board": 3}
BATCHES = ["提前批", "正式批", "补录", "实习转正"]


def is_campus_season(month) -> Column:
    return F.coalesce(col(month).isin(SEASON_MONTHS), F.lit(False))


def is_due(last, now, minutes: int = 50) -> Column:
    """Missing and future stamps are due."""
    t, n = ts(last), at(now)
    return t.isNull() | (t > n) | (t <= n - F.expr(f"interval {minutes} minutes"))


def retry_days(state, month=None) -> Column:
    """Days to wait after a failed state, shorter for waiting boards in season; unknown states 30."""
    chain, season = None, is_campus_season(month) if month is not None else F.lit(False)
    for s, d in RETRY_DAYS.items():
        value = F.when(season, SEASON_RETRY_DAYS[s]).otherwise(d) if s in SEASON_RETRY_DAYS else F.lit(d)
        chain = F.when(col(state) == s, value) if chain is None else chain.when(col(state) == s, value)
    return chain.otherwise(30)


def is_surge(prev, cur, multiple: int = 3, delta: int = 50) -> Column:
    p, c = col(prev), col(cur)
    return F.coalesce((c > p) & (((p > 0) & (c >= p * multiple)) | (c >= p + delta)), F.lit(False))


def surges(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the one before and whether the count jumped; a first one never does."""
    w = Window.partitionBy("source_id").orderBy("captured_at")
    s = snapshots.withColumn("prev_count", F.lag("campus_count").over(w))
    return s.withColumn("surge", is_surge("prev_count", "campus_count"))


def recent_surges(dim: DataFrame, snapshots: DataFrame, now, days: int = 7) -> DataFrame:
    """Newest recent surge per list entry, by the company name of the source."""
    hot = snapshots.where(F.col("surge") & (F.col("captured_at") >= at(now) - F.expr(f"interval {days} days")))
    newest = F.max(F.struct("captured_at", "source_id", "campus_count"))
    # the newest of a company, then of a needle: list rows of one needle share its answer
    by_company = hot.groupBy("company").agg(newest.alias("_best"))
    entries = dim.select("pos", F.lower(text("needle")).alias("_key"))
    hit = C.contains_join(by_company, "company", entries.select("_key").distinct(), "_key").groupBy("_key").agg(F.max("_best").alias("_best"))
    return entries.join(hit, "_key").groupBy("pos").agg(F.max("_best").alias("_best")).select("pos", "_best.campus_count", "_best.captured_at")


def crawl_campus_predicate(job_type="job_type", title="title") -> Column:
    """Coarse and stable counting rule of the crawl lane; not the display rule."""
    return text(job_type).rlike("校|应届|campus|Campus|graduate|Graduate") | text(title).rlike("校招|校园招聘|应届|秋招|春招")


def campus_counts(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("status") == "active") & crawl_campus_predicate()).groupBy("source_id").agg(F.count("*").alias("campus_count"))


def campus_producers(jobs: DataFrame, now, days: int) -> DataFrame:
    return jobs.where(crawl_campus_predicate() & (F.col("first_seen_at") >= at(now) - F.expr(f"interval {days} days"))).select("source_id").distinct()


def campus_sources(sources: DataFrame, producers: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Enabled sources with a campus board or recent campus postings, on the list when one is given."""
    p = producers.select(F.col("source_id").alias("id"), F.lit(True).alias("_p"))
    s = sources.where("enabled").join(p, "id", "left").where(F.col("board").isin("campus", "mixed") | F.col("_p")).drop("_p")
    return s.join(names.select("company").distinct(), "company", "left_semi") if names is not None else s


def campus_admission(category) -> Column:
    return F.when(col(category) == "实习", "intern").when(col(category) == "校招", "campus").otherwise("reject")


def current_class(now) -> Column:
    d = at(now)
    return F.year(d) + F.when(F.month(d) >= 5, 1).otherwise(0)


def campus_zone(jobs: DataFrame, dim: DataFrame, now) -> DataFrame:
    """Per list company: campus and intern postings of the current class, older ones counted, last seen."""
    pre = (text("job_type").rlike(r"(?i)校|campus|应届|管培|培训生|graduate|new.?grad|实习|intern")
           | text("title").rlike(r"(?i)校|应届|届|管培|培训生|graduate|campus|new.?grad|实习|intern")
           | text("jd_url").rlike(r"(?i)/(?:xiaozhao|campus|shixi|intern)(?:/|\?|$)"))
    j = jobs.where((F.col("status") == "active") & pre)
    owners = CV.assign_owner(j.select("company").where("company is not null").distinct(), dim)
    # classified where the texts lie; the join carries flags only
    j = j.withColumn("_s", T.asks_experience("title", "experience", "summary"))
    bucket = campus_admission(T.recruitment_category("title", "job_type", "summary", "jd_url", "company", senior=F.col("_s")))
    current = F.col("grad_class").isNull() | (F.col("grad_class") >= current_class(now))
    j = j.select("company", bucket.alias("bucket"), current.alias("_current"), "last_seen_at").join(owners, "company")
    current, kept = F.col("_current"), F.col("bucket") != "reject"
    # counts only: posting lists of a company can be long, read them with campus_jobs
    g = j.groupBy("pos").agg(F.count_if((F.col("bucket") == "campus") & current).alias("campus_jobs"), F.count_if((F.col("bucket") == "intern") & current).alias("intern_jobs"),
                             F.count_if(kept & ~current).alias("past_class"), F.max("last_seen_at").alias("last_seen_at"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return dim.select("pos", "name").join(g, "pos", "left").select("pos", "name", z("campus_jobs"), z("intern_jobs"), z("past_class"), "last_seen_at")


def window_state(campus_jobs, has_campus_source, has_any, last_seen, now) -> Column:
    n = col(campus_jobs)
    return (F.when((n > 0) & (hours_between(at(now), last_seen) > 72), "stale").when(n > 0, "hiring").when(col(has_campus_source), "no_campus_now")
             .when(col(has_any), "source_only_social").otherwise("no_source"))


def campus_page(jobs: DataFrame, dim: DataFrame, sources: DataFrame, now, cycles: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Cards of the campus page in display order: zone counts, source flags, window state, and (with cycles and profiles) the
    company's recruitment cycles by batch and start."""
    z = campus_zone(jobs, dim, now).join(CV.source_flags(dim, sources).drop("name"), "pos")
    if cycles is not None:
        one = F.struct(batch_rank().alias("rank"), F.col("month_start"), F.col("id"), "season", "batch", "event", "value_text", "month_end")
        own = cycles_for(dim, cycles, profiles, now).groupBy("pattern").agg(F.array_sort(F.collect_list(one)).alias("cycles"))
        z = z.join(dim.select("pos", "pattern"), "pos").join(own, "pattern", "left").drop("pattern")
    z = z.withColumn("window", window_state("campus_jobs", "has_campus", "has_any", "last_seen_at", now))
    rank = F.when(F.col("window") == "hiring", 0).when(F.col("window") == "no_campus_now", 1).when(F.col("window") == "stale", 2).otherwise(3)
    return z.withColumn("rank", rank).orderBy("rank", "pos")


def campus_job_order() -> list[Column]:
    """A dated posting first, the nearest deadline first, then the newest."""
    return [F.try_to_timestamp("deadline").asc_nulls_last(), F.col("first_seen_at").desc_nulls_last(), F.col("id")]


def group_by_city(jobs: DataFrame) -> DataFrame:
    key = F.coalesce(F.nullif(F.trim(text("location")), F.lit("")), F.lit("其他"))
    return jobs.groupBy(key.alias("city")).agg(F.count("*").alias("n"))


def usable_cycles(obs: DataFrame, now) -> DataFrame:
    """Verified, unexpired rows of the season now preferred per company, else of the others."""
    n = at(now)
    rows = obs.where((F.coalesce("verify_status", F.lit("verified")) == "verified") & (F.col("valid_until").isNull() | (F.col("valid_until") >= F.to_date(n))))
    prefer = F.when(F.month(n) >= 5, "秋招").otherwise("春招")
    w = Window.partitionBy("company_id")
    r = rows.withColumn("_has", F.max((F.col("season") == prefer).cast("int")).over(w))
    return r.where((F.col("_has") == 0) | (F.col("season") == prefer)).drop("_has")


CYCLE_FIELDS = ["grad_class", "season", "batch", "event", "time_expr_type", "value_text", "month_start", "month_end", "confidence", "evidence_url", "evidence_excerpt", "valid_until"]


def cycles_for(dim: DataFrame, cycles: DataFrame, profiles: DataFrame, today) -> DataFrame:
    """Rows of the verified, unexpired cycles of each list company: (pattern, cycle id, CYCLE_FIELDS).

    A cycle belongs to a list company if its profile (name or an alias) matches the company's name. Names are matched once
    per distinct name; entries that share a pattern share their cycles. Open-ended cycles never expire.
    """
    live = cycles.where((F.col("verify_status") == "verified") & (F.col("valid_until").isNull() | (F.col("valid_until") >= F.to_date(at(today)))))
    wide = live.select("id", "company_id", *[F.col(c) if c in cycles.columns else F.lit(None).cast("string").alias(c) for c in CYCLE_FIELDS])
    found = IN.matching_profiles(dim.select(F.col("name").alias("company")), profiles)
    own = dim.select("pattern", F.col("name").alias("company")).join(found, "company").select("pattern", F.col("profile_id").alias("company_id")).distinct()
    return own.join(wide, "company_id").drop("company_id")


def batch_rank() -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(b) for b in BATCHES]), F.col("batch")), F.lit(0)), F.lit(9))


def campus_timeline(obs: DataFrame, now) -> DataFrame:
    """Per company: the earliest window of every batch in order, and where the present month lies."""
    m = F.month(at(now))
    u = usable_cycles(obs.where("month_start is not null and event in ('开放', '黄金期')"), now)
    one = C.latest_per_key(u, ["company_id", "batch"], [F.col("month_start"), F.col("id")])
    s, e = F.col("month_start"), F.col("month_end")
    inside = F.when(s <= e, (m >= s) & (m <= e)).otherwise((m >= s) | (m <= e))
    one = one.withColumn("_r", batch_rank()).withColumn("_in", F.coalesce(inside, F.lit(False)))
    g = one.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "batch", "value_text"))), lambda x: F.concat(x["batch"], x["value_text"])), ",").alias("batches"),
                                      F.min_by(F.when(F.col("event") == "黄金期", "现处黄金期").otherwise(F.concat(F.lit("现处"), F.col("batch"))), F.when(F.col("_in"), F.col("_r"))).alias("_hit"),
                                      F.bool_or("_in").alias("_any"), F.max(F.coalesce("month_end", "month_start")).alias("_end"))
    late = (m > F.col("_end")) & (m - F.col("_end") <= 3)
    return g.select("company_id", "batches", F.when(F.col("_any"), F.col("_hit")).when(late, "往年这时多已近尾声").alias("phase"))


def precise_dates(obs: DataFrame, now) -> DataFrame:
    u = usable_cycles(obs, now).where("time_expr_type in ('精确日期', '日期范围')")
    return C.latest_per_key(u, ["company_id", "batch"], [F.col("id")]).select("company_id", "batch", "value_text")


def batch_gap(obs: DataFrame, now) -> DataFrame:
    """Weeks between the early and the regular batch, 4.3 weeks a month."""
    u = usable_cycles(obs, now).where("event = '开放' and month_start is not null")
    first = lambda b: F.min_by(F.when(F.col("batch") == b, F.col("month_start")), F.when(F.col("batch") == b, F.col("id")))
    g = u.groupBy("company_id").agg(first("提前批").alias("early"), first("正式批").alias("main"))
    weeks = js_round((F.col("main") - F.col("early")) * 4.3).cast("int")
    return g.select("company_id", weeks.alias("weeks")).where("weeks > 0")


def overlap_counts(claims: DataFrame) -> DataFrame:
    """For every claim, how many different publishers overlap it inside its company, season, batch and event,
    and whether an official one does.

    A missing last month is the first one; ranges that run backwards have no months and leave. Claims are first reduced
    to distinct (publisher, months), so a hot company costs its distinct ranges, at most 144, not its pairs of claims.
    """
    keys = ["company_id", "season", "batch", "event"]
    official = F.coalesce(F.col("official"), F.lit(False)) if "official" in claims.columns else F.lit(False)
    claims = claims.withColumn("month_end", F.coalesce("month_end", "month_start")).where("month_start <= month_end").withColumn("_official", official)
    span = lambda: F.explode(F.sequence("month_start", "month_end")).alias("m")
    ranges = claims.select(*keys, "month_start", "month_end").distinct()
    months = claims.select(*keys, "publisher", "_official", span()).distinct()
    n = ranges.select("*", span()).join(months, [*keys, "m"]).groupBy(*keys, "month_start", "month_end").agg(
        F.countDistinct("publisher").alias("n_pub"), F.bool_or("_official").alias("has_official"))
    return claims.drop("_official").join(n, [*keys, "month_start", "month_end"])


def cycle_consensus(claims: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Anchor of each event: most publishers, then the narrowest, then the earliest range. Two publishers or an official
    one make it verified.

    prior (keys, status): a verified event is left alone, and a draft is not repeated by a draft.
    """
    keys = ["company_id", "season", "batch", "event"]
    best = C.latest_per_key(overlap_counts(claims), keys, [F.col("n_pub").desc(), F.col("month_end") - F.col("month_start"), F.col("month_start"), F.col("id")])
    status = F.when(F.col("has_official") | (F.col("n_pub") >= 2), "verified").otherwise("draft")
    out = best.select(*keys, "month_start", "month_end", "n_pub", status.alias("status"))
    if prior is None:
        return out
    old = prior.groupBy(*keys).agg(F.bool_or(F.col("status") == "verified").alias("_done"), F.bool_or(F.col("status") == "draft").alias("_draft"))
    out = out.join(old, keys, "left")
    skip = F.coalesce("_done", F.lit(False)) | (F.coalesce("_draft", F.lit(False)) & (F.col("status") == "draft"))
    return out.where(~skip).drop("_done", "_draft")


def duplicate_boards(existing: DataFrame, candidates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Candidate boards whose posting identities mostly exist already; no identity counts as duplicate."""
    known = existing.select("tenant", U.job_identity("jd_url").alias("ident")).where("ident is not null").distinct().withColumn("_known", F.lit(1))
    cand = candidates.select("tenant", "board", U.job_identity("jd_url").alias("ident")).distinct()
    have = known.select("tenant").distinct().withColumn("_have", F.lit(1))
    g = (cand.join(known, ["tenant", "ident"], "left").join(have, "tenant", "left").groupBy("tenant", "board")
         .agg(F.count("ident").alias("total"), F.count("_known").alias("shared"), F.max("_have").alias("_have")))
    dup = (F.col("total") == 0) | F.col("_have").isNull() | (F.col("shared") >= F.col("total") * threshold)
    return g.select("tenant", "board", "total", "shared", dup.alias("duplicate"))


def campus_candidates(sources: DataFrame, ledger: DataFrame, now) -> DataFrame:
    """First campus address per tenant that is not a source yet and not waiting in the ledger."""
    s = sources.withColumn("candidate", U.campus_url("adapter_name", "source_url")).withColumn("tenant", U.tenant("adapter_name", "source_url")).where("enabled and candidate is not null")
    one = C.latest_per_key(s, ["tenant"], [F.col("id")])
    one = one.join(sources.select(F.col("source_url").alias("candidate")).distinct(), "candidate", "left_anti")
    waiting = ledger.where(F.col("next_retry_at") > at(now)).select("candidate").distinct()
    return one.join(waiting, "candidate", "left_anti").select("id", "tenant", "candidate")


def classify_board(results: DataFrame) -> DataFrame:
    """An empty result is a waiting board if something was processed without failure."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return results.withColumn("state", F.when(z("failed") >= 1, "no_healthy_jobs").when(z("success") + z("empty") >= 1, "empty_board").otherwise("no_healthy_jobs"))


def board_decisions(results: DataFrame, boards: DataFrame, now) -> DataFrame:
    """What a probed board's result means and when to look again: results (candidate, failed, success, empty, reason), boards (id,
    candidate, duplicate_of) as found beforehand.

    A board that another source already covers is a duplicate whatever was fetched; robots and unreachable boards keep that
    reason; else classify_board decides. Waiting boards are retried sooner in the season.
    """
    b = boards.select("candidate", "duplicate_of").groupBy("candidate").agg(F.min("duplicate_of").alias("duplicate_of"))
    rows = classify_board(results).join(b, "candidate", "left")
    state = F.when(F.col("duplicate_of").isNotNull(), "duplicate_board").when(F.col("reason").isin("robots_blocked", "unreachable"), F.col("reason")).otherwise(F.col("state"))
    rows = rows.withColumn("state", state)
    return rows.withColumn("next_retry_at", at(now) + F.make_dt_interval(days=retry_days("state", F.month(at(now))).cast("int")))


def coverage_ratio(inserted, total) -> Column:
    return F.when(col(total) > 0, col(inserted) / col(total))


def undercrawled(inserted, total, threshold: float = 0.9) -> Column:
    return coverage_ratio(inserted, total) < threshold
