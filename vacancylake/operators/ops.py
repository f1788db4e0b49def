"""Operations dashboard: crawl, discovery, task, user and event figures."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.base import at, blank_to_null, shanghai_date, text
from ..functions.text import is_valid_active
from . import core as C


def today_start(now) -> Column:
    """Start of the Shanghai day, as an instant."""
    local = F.date_trunc("day", F.from_utc_timestamp(at(now), "Asia/Shanghai"))
    return F.to_utc_timestamp(local, "Asia/Shanghai")


def today_date(now) -> Column:
    return F.to_date(F.from_utc_timestamp(at(now), "Asia/Shanghai"))


def with_bounds(df: DataFrame, now, window_days: int = 7) -> DataFrame:
    """The job's time bounds as constant columns (a cross join with one row, folded away)."""
    return (df.withColumn("since_at", at(now) - F.expr(f"interval {window_days} days"))
              .withColumn("today_start", today_start(now)).withColumn("today_date", today_date(now)))


def jobs_health(jobs: DataFrame, now) -> DataFrame:
    start = today_start(now)
    c = jobs.agg(
        F.count_if(is_valid_active("status", "summary")).alias("valid_active"),
        F.count_if(F.col("first_seen_at") >= start).alias("today_new"),
        F.count_if((F.col("last_seen_at") >= start) & (F.col("first_seen_at") < start)).alias("today_updated"),
        F.count_if(F.col("status") == "active").alias("active_total"),
        F.count_if(F.col("status") == "expired").alias("expired"),
        F.count_if(F.col("status") == "removed").alias("removed"), F.count("*").alias("total"),
        F.count_if((F.col("status") == "active") & F.col("enrich_checked_at").isNull()).alias("never_checked"))
    return c.withColumn("thin_active", F.greatest(F.lit(0), F.col("active_total") - F.col("valid_active")))


def runs_in_window(sources: DataFrame, runs: DataFrame, since) -> DataFrame:
    """Enabled sources with their runs since a time; sources without runs stay."""
    s = sources.where("enabled").select(F.col("id").alias("source_id"), "company", F.coalesce("adapter_name", F.lit("unknown")).alias("adapter_name"))
    r = runs.where(F.col("started_at") >= since).select("source_id", F.col("id").alias("run_id"), "status")
    return s.join(r, "source_id", "left")


def rate(num: Column, den: Column) -> Column:
    """Share with one decimal as text; a dash without a base."""
    return F.when(den > 0, F.concat(F.format_number(num / den * 100, 1), F.lit("%"))).otherwise("—")


def crawl_source_stats(sources: DataFrame, runs: DataFrame, now, days: int = 7) -> DataFrame:
    rows = runs_in_window(sources, runs, at(now) - F.expr(f"interval {days} days"))
    n = lambda s: F.count_if(F.col("status") == s)
    g = rows.groupBy("source_id", "company", "adapter_name").agg(
        F.count("run_id").alias("runs"), n("success").alias("success"), n("partial_success").alias("partial_success"),
        n("failed").alias("failed"), n("skipped").alias("skipped"))
    terminal = F.col("success") + F.col("partial_success") + F.col("failed")
    return (g.withColumn("success_rate", rate(F.col("success"), terminal))
             .withColumn("partial_rate", rate(F.col("partial_success"), terminal)))


def crawl_today(runs: DataFrame, now) -> DataFrame:
    r = runs.where(F.col("started_at") >= today_start(now))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return r.agg(F.count("*").alias("runs"), z("jobs_found"), z("jobs_created"), z("jobs_updated"),
                 F.count_if(F.col("status") == "failed").alias("failed_runs"),
                 F.countDistinct(F.when(F.col("status") == "failed", F.col("source_id"))).alias("failed_sources"),
                 F.max(F.coalesce("finished_at", "started_at")).alias("last_run_at"))


def discovery_today(runs: DataFrame, now) -> DataFrame:
    r = runs.where(F.col("created_at") >= today_start(now))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return r.agg(F.count("*").alias("runs"), z("jobs_created"), z("jobs_updated"),
                 F.count_if(F.col("status") == "failed").alias("failed_runs"),
                 F.max(F.coalesce("finished_at", "started_at", "created_at")).alias("last_run_at"))


def number_metric(metrics, key: str) -> Column:
    """A metric of a JSON payload, counted only when it is a JSON number."""
    raw = F.get_json_object(F.col(metrics), f"$.{key}")
    quoted = F.regexp_like(F.col(metrics), F.lit(f'"{key}"\\s*:\\s*"'))
    return F.when(~quoted, raw.try_cast("double").cast("int"))


OPS_METRICS = ["checked", "expired", "deleted", "enriched", "companies_enriched", "retired"]


def ops_today(ops: DataFrame, now, metrics=OPS_METRICS) -> DataFrame:
    o = ops.where(shanghai_date("created_at") == today_date(now))
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return o.groupBy("module").agg(F.count("*").alias("runs"), n("success"), n("partial"), n("failed"),
                                   *[F.coalesce(F.sum(number_metric("metrics", m)), F.lit(0)).alias(m) for m in metrics],
                                   F.max("created_at").alias("last_run_at"))


def discovery_modes(runs: DataFrame, since) -> DataFrame:
    done = F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()
    secs = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000
    return runs.where(F.col("created_at") >= since).groupBy(F.coalesce("mode", F.lit("web_search")).alias("mode")).agg(
        F.count("*").alias("runs"), F.count_if(done).alias("completed_runs"), F.round(F.avg(F.when(done, secs)), 1).alias("avg_seconds"))


def discovery_failures(runs: DataFrame, since) -> DataFrame:
    reason = F.coalesce(blank_to_null("failure_reason"), blank_to_null(F.get_json_object("diagnostics", "$.failure_reason")),
                        F.when(F.col("status") == "partial_success", "partial_success_unspecified").otherwise("unknown"))
    rows = runs.where((F.col("created_at") >= since) & F.col("status").isin("failed", "partial_success"))
    return rows.groupBy(F.coalesce("mode", F.lit("web_search")).alias("mode"), reason.alias("reason")).agg(F.count("*").alias("n"))


def insight_totals(items: DataFrame, disputes: DataFrame) -> DataFrame:
    dims = items.where("status = 'active'").groupBy("dimension").agg(F.count("*").alias("n")).select(F.concat(F.lit("dimension:"), "dimension").alias("figure"), "n")
    d = disputes.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open"))
    return dims.union(d.select(F.lit("disputes_total"), "total")).union(d.select(F.lit("disputes_open"), "open"))


def user_funnel(users: DataFrame, prefs: DataFrame, actions: DataFrame, now) -> DataFrame:
    """Users, those with preferences, savers and appliers, with today's figures."""
    start = today_start(now)
    act = lambda a: F.col("action") == a
    a = actions.agg(
        F.countDistinct(F.when(act("saved"), F.col("user_id"))).alias("saved_users"),
        F.countDistinct(F.when(act("applied"), F.col("user_id"))).alias("applied_users"),
        F.count_if(act("saved")).alias("saved_total"), F.count_if(act("saved") & (F.col("created_at") >= start)).alias("saved_today"),
        F.count_if(act("applied")).alias("applied_total"), F.count_if(act("applied") & (F.col("created_at") >= start)).alias("applied_today"))
    u = users.agg(F.count("*").alias("total_users"))
    p = prefs.agg(F.countDistinct("user_id").alias("users_with_preferences"))
    one = F.lit(1)
    k = lambda d: d.withColumn("_k", one)
    return k(a).join(k(u), "_k").join(k(p), "_k").drop("_k")


def resume_today(events: DataFrame, now) -> DataFrame:
    e = events.where(F.col("created_at") >= today_start(now))
    ok = F.col("event") == "resume_parse_succeeded"
    src = F.get_json_object("payload", "$.diagnostics.source")
    return e.agg(F.count_if(F.col("event") == "resume_parse_started").alias("started"), F.count_if(ok).alias("succeeded"),
                 F.count_if(ok & (src == "llm")).alias("llm"), F.count_if(ok & (src == "rule")).alias("rule"))


OPEN_EVENT, LIVENESS_EVENT = "opportunity_official_opened", "job_liveness_at_click"


def _liveness(events: DataFrame) -> DataFrame:
    result = F.get_json_object("payload", "$.result")
    return events.where(F.col("event") == LIVENESS_EVENT).select(
        F.coalesce(blank_to_null(F.get_json_object("payload", "$.adapter")), F.lit("unknown")).alias("adapter"),
        F.when(result.isin("alive", "dead"), result).otherwise("unknown").alias("result"))


def click_validity(events: DataFrame) -> DataFrame:
    """Opens, probe results and the three rates that are only meaningful together."""
    result = F.get_json_object("payload", "$.result")
    probe = F.col("event") == LIVENESS_EVENT
    g = events.where(F.col("event").isin(OPEN_EVENT, LIVENESS_EVENT)).agg(
        F.count_if(F.col("event") == OPEN_EVENT).alias("opens"), F.count_if(probe).alias("probes"),
        F.count_if(probe & (result == "alive")).alias("alive"), F.count_if(probe & (result == "dead")).alias("dead"))
    known = F.col("alive") + F.col("dead")
    div = lambda a, b: F.when(b > 0, a / b)
    return (g.withColumn("unknown", F.col("probes") - known)
             .withColumn("validity_rate", div(F.col("alive"), known)).withColumn("coverage_rate", div(known, F.col("opens")))
             .withColumn("unknown_rate", div(F.col("probes") - known, F.col("probes"))))


def click_validity_by_adapter(events: DataFrame) -> DataFrame:
    n = lambda r: F.count_if(F.col("result") == r).alias(r)
    g = _liveness(events).groupBy("adapter").agg(n("alive"), n("dead"), n("unknown"))
    known = F.col("alive") + F.col("dead")
    return g.withColumn("validity_rate", F.when(known > 0, F.col("alive") / known))


EVENT_NAME_MAX = 64


def event_counts(events: DataFrame, since) -> DataFrame:
    """Events per name; blank and over-long names are no events."""
    name = F.trim(text("event"))
    return events.where((F.col("created_at") >= since) & F.length(name).between(1, EVENT_NAME_MAX)).groupBy(name.alias("event")).agg(F.count("*").alias("n"))


def supply_ledger(ops: DataFrame, coverage: DataFrame) -> DataFrame:
    """Sources really added by the newest runs of the two gap modules, and gains by definition only."""
    o = ops.where(F.col("module").isin("gap_funnel", "gap_funnel_browser")).withColumn("run_date", shanghai_date("created_at"))
    last = o.agg(F.max("run_date").alias("last_date"))
    rows = C.latest_per_key(o.join(last, F.col("run_date") == F.col("last_date")), ["module"], [F.col("created_at").desc(), F.col("id").desc()])
    real = rows.agg(F.sum(number_metric("metrics", "sources_added")).alias("real_expansion")).withColumn("_k", F.lit(1))
    defined = coverage.agg(F.count_if(F.col("via_parent") & (F.col("direct_healthy") == 0)).alias("definition_change")).withColumn("_k", F.lit(1))
    return real.join(defined, "_k").drop("_k")


MANUAL_STATES = ["manual_review", "anti_bot", "login_wall", "no_stable_jd"]


def gap_summary(attempts: DataFrame) -> DataFrame:
    """Rows of three kinds: state counts, the five newest failures, companies left for a person."""
    state = attempts.groupBy(F.coalesce(blank_to_null("state"), F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))
    state = state.select(F.lit("state").alias("kind"), "label", "n")
    order = [F.col("last_attempt_at").desc_nulls_last(), F.col("company")]
    fails = attempts.where(F.trim(text("fail_reason")) != "").orderBy(*order).limit(5).select(F.lit("failure"), "company", F.lit(1).cast("long"))
    manual = attempts.where(F.col("state").isin(MANUAL_STATES) & F.col("next_retry_at").isNull()).select(F.lit("manual"), "company", F.lit(1).cast("long"))
    return state.union(fails).union(manual)


REPORT_MODULES = {
    "enrichment": ["enrich_backlog"], "dead_jobs": ["liveness_sweep", "dead_link_audit", "purge_expired"],
    "insights": ["insight_backlog", "insight_staleness"],
    "auto_discover": ["auto_discover", "auto_discover_browser", "auto_discover_overseas"],
}


def report_status(runs, failed) -> Column:
    return F.when(F.col(runs) <= 0, "idle").when(F.col(failed) >= F.col(runs), "failed").otherwise("success")


def daily_reports(crawl: DataFrame, discovery: DataFrame, ops: DataFrame, modules=REPORT_MODULES) -> DataFrame:
    """Status of each report from today's run counts; ``ops`` is ``ops_today``."""
    key = None
    for k, ms in modules.items():
        hit = F.col("module").isin(ms)
        key = F.when(hit, k) if key is None else key.when(hit, k)
    o = ops.withColumn("report", key).where("report is not null").groupBy("report").agg(
        F.sum("runs").alias("runs"), F.sum("failed").alias("failed"), F.max("last_run_at").alias("last_run_at"))
    base = crawl.select(F.lit("crawl").alias("report"), "runs", F.col("failed_runs").alias("failed"), "last_run_at").union(
        discovery.select(F.lit("discovery"), "runs", "failed_runs", "last_run_at"))
    every = crawl.select(F.explode(F.array(*[F.lit(k) for k in modules])).alias("report"))
    rest = every.join(o, "report", "left").select("report", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("failed", F.lit(0)).alias("failed"), "last_run_at")
    return base.union(rest).withColumn("status", report_status("runs", "failed"))


def band(value: Column, good: float, warn: float, higher: bool = True) -> Column:
    if higher:
        return F.when(value.isNull(), "empty").when(value >= good, "good").when(value >= warn, "warn").otherwise("bad")
    return F.when(value.isNull(), "empty").when(value < good, "good").when(value <= warn, "warn").otherwise("bad")


# fixed values: (good, warn) limits
THRESHOLDS = {"click": (0.99, 0.9), "healthy_companies": (28, 24), "coverage": (90, 60), "zero_warn": 1, "zero_bad": 5}


def health_verdict(m: DataFrame, th=THRESHOLDS) -> DataFrame:
    """One row of figures to level, bands and the three most urgent actions.

    Figures: valid_active, crawl_runs, crawl_failed, click_rate, healthy_companies,
    total_companies, zero_companies, blind_companies (arrays), coverage_pct, blind_sources.
    """
    c = F.col
    zero = F.size("zero_companies")
    raw = band(c("healthy_companies"), *th["healthy_companies"])
    must = F.when(zero >= th["zero_bad"], "bad").when((zero >= th["zero_warn"]) & (raw == "good"), "warn").otherwise(raw)
    click, cover = band(c("click_rate"), *th["click"]), band(c("coverage_pct"), *th["coverage"])
    all_failed = (c("crawl_runs") > 0) & (c("crawl_failed") >= c("crawl_runs"))
    names = lambda a: F.concat(F.array_join(F.slice(a, 1, 3), "、"), F.when(F.size(a) > 3, F.concat(F.lit("等 "), F.size(a).cast("string"), F.lit(" 家"))).otherwise(""))
    off = lambda b: b.isin("bad", "warn")
    act = F.array_compact(F.array(
        F.when(zero > 0, F.concat(names(c("zero_companies")), F.lit("：必投公司零健康岗"))),
        F.when(c("healthy_companies").isNull(), "必投清单健康覆盖暂不可用"),
        F.when(off(click), F.concat(F.lit("点击有效率 "), F.coalesce(F.concat(F.format_number(c("click_rate") * 100, 1), F.lit("%")), F.lit("暂无数据")))),
        F.when(c("valid_active").isNull(), "岗位库统计暂不可用").when(c("valid_active") <= 0, "当前没有能投岗位"),
        F.when(all_failed, "今天岗位抓取全部失败").when(c("crawl_runs") <= 0, "今天还没有岗位抓取记录"),
        F.when((must == "warn") & (zero == 0) & c("healthy_companies").isNotNull(),
               F.concat(F.lit("必投清单健康覆盖 "), c("healthy_companies").cast("string"), F.lit("/"), c("total_companies").cast("string"))),
        F.when(F.size("blind_companies") > 0, F.concat(names(c("blind_companies")), F.lit("：有岗但 72h 未核验"))),
        F.when(off(cover), F.concat(F.lit("全库抓全率 "), c("coverage_pct").cast("string"), F.lit("%"))),
        F.when(c("blind_sources") > 0, F.concat(c("blind_sources").cast("string"), F.lit(" 个招聘源算不出抓全率")))))
    critical = (c("valid_active") <= 0) | all_failed | (click == "bad") | (must == "bad")
    warning = (c("valid_active").isNull() | (c("crawl_runs") <= 0) | must.isin("empty", "warn") | (zero > 0)
               | (F.size("blind_companies") > 0) | off(cover) | (click == "warn"))
    yes = lambda b: F.coalesce(b, F.lit(False))
    level = F.when(yes(critical), "critical").when(yes(warning), "warning").otherwise("healthy")
    return (m.withColumn("click_band", click).withColumn("must_band", must).withColumn("coverage_band", cover).withColumn("level", level)
             .withColumn("actions", F.when(level == "healthy", F.array().cast("array<string>")).otherwise(F.slice(act, 1, 3))))


def budget_status(usage: DataFrame, caps: DataFrame, now) -> DataFrame:
    """Calls per provider in the current Shanghai day against its cap."""
    u = usage.where(shanghai_date("created_at") == today_date(now)).groupBy("provider").agg(F.sum("calls").alias("used"))
    return (caps.join(u, "provider", "left").withColumn("used", F.coalesce("used", F.lit(0)))
            .withColumn("remaining", F.greatest(F.lit(0), F.col("cap") - F.col("used"))).withColumn("exhausted", F.col("used") >= F.col("cap")))


def reconcile(expected: DataFrame, actual: DataFrame, keys, values) -> DataFrame:
    """Keys whose figures differ, or that stand on one side only."""
    a = expected.select(*keys, *[F.col(v).alias("want_" + v) for v in values])
    b = actual.select(*keys, *[F.col(v).alias("got_" + v) for v in values])
    same = F.lit(True)
    for v in values:
        same = same & F.col("want_" + v).eqNullSafe(F.col("got_" + v))
    return a.join(b, keys, "full_outer").where(~same)


def crawl_summary(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    empty = (F.col("status") == "success") & (F.col("jobs_found") == 0)
    return results.agg(n("success").alias("success"), n("failed").alias("failed"), n("skipped").alias("skipped"),
                       F.count_if(empty).alias("empty"), F.sum("jobs_created").alias("created"), F.sum("jobs_updated").alias("updated"))


def ops_run_rows(stats: DataFrame) -> DataFrame:
    """Ledger rows of finished tasks: status from the counts, Shanghai date."""
    failed, done = F.coalesce("failed", F.lit(0)), F.coalesce("done", F.lit(0))
    status = F.when((failed > 0) & (done == 0), "failed").when(failed > 0, "partial").otherwise("success")
    return stats.withColumn("status", status).withColumn("run_date", shanghai_date("finished_at"))


def crawl_run_rows(batch: DataFrame, rejects: DataFrame, now) -> DataFrame:
    """Run ledger from a normalised batch and its rejects: counts and a histogram of reasons."""
    found = batch.groupBy("source_id").agg(F.count("*").alias("jobs_found"), F.count_if("created").alias("jobs_created"),
                                           F.count_if(~F.col("created")).alias("jobs_updated"))
    why = rejects.groupBy("source_id", "reject_reason").agg(F.count("*").alias("n")).groupBy("source_id").agg(
        F.sum("n").alias("rejected"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reject_reason", "n")))).alias("reasons"))
    out = found.join(why, "source_id", "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source_id", z("jobs_found"), z("jobs_created"), z("jobs_updated"), z("rejected"), "reasons",
                      F.when(F.coalesce("jobs_found", F.lit(0)) == 0, "failed").when(F.coalesce("rejected", F.lit(0)) > 0, "partial_success")
                      .otherwise("success").alias("status"), at(now).alias("started_at"))


def adapter_breaker(checks: DataFrame, min_checks: int = 50, ratio: float = 0.7) -> DataFrame:
    """First check per adapter at which its running share of misses trips the breaker."""
    w = Window.partitionBy("adapter").orderBy("checked_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = (checks.withColumn("seen", F.count("*").over(w)).withColumn("misses", F.sum(F.col("miss").cast("long")).over(w))
           .where((F.col("seen") >= min_checks) & (F.col("misses") >= F.col("seen") * ratio)))
    return C.latest_per_key(run, ["adapter"], [F.col("seen")])


def ops_dashboard(jobs, sources, runs, discovery, ops, events, users, prefs, actions, now) -> DataFrame:
    """All figures as rows (section, figure, value), one small frame per section joined by union."""
    def tall(section, df, skip=("last_run_at",)):
        cols = [c for c, t in df.dtypes if c not in skip and t in ("bigint", "int", "double")]
        stack = F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in cols]))
        return df.select(F.lit(section).alias("section"), stack.alias("x")).select("section", "x.figure", "x.value")
    from .coverage import coverage_snapshot
    parts = [tall("jobs", jobs_health(jobs, now)), tall("crawl_today", crawl_today(runs, now)),
             tall("discovery_today", discovery_today(discovery, now)), tall("coverage", coverage_snapshot(runs, sources)),
             tall("users", user_funnel(users, prefs, actions, now)), tall("resume", resume_today(events, now)),
             tall("clicks", click_validity(events))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
