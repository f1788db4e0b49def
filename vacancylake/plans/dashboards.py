"""Coverage and operations figures over whole tables."""
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.base import at
from ..operators import core as C, coverage as CV, ops as O
from .registry import query
from .roles import EVENTS_NOW, NOW

N = f"timestamp '{NOW}'"
EN = f"timestamp '{EVENTS_NOW}'"
TODAY = f"(date_trunc('day', {N} + interval 8 hours) - interval 8 hours)"
ETODAY = f"(date_trunc('day', {EN} + interval 8 hours) - interval 8 hours)"
AGG = f"""count(*) as active_total, count(*) filter (length(trim(summary, ' ')) >= 60) as healthy,
  count(*) filter (first_seen_at > {N} - interval 7 day) as new_7d, count(*) filter (enrich_checked_at > {N} - interval 72 hour) as checked_72h"""
PCT = "case when reported_total > 0 then cast(round(least(100, cast(fetched as decimal(20,0)) * 100 / cast(reported_total as decimal(20,0)))) as int) end"
LATEST = "select * from (select *, row_number() over (partition by source_id order by started_at desc nulls last, id desc) rn from r_runs) where rn = 1"
SCORED = f"""l as (select r.source_id, s.company, s.adapter_name as adapter, r.reported_total, coalesce(r.jobs_found, 0) as fetched from ({LATEST}) r join r_sources s on s.id = r.source_id where s.enabled),
  sc as (select *, {PCT} as coverage_pct from l)"""
WINDOW = "interval 400 day"


@query("jobs_health", f"""select *, greatest(0, active_total - valid_active) as thin_active from (select count(*) filter (status = 'active' and length(trim(summary, ' ')) >= 60) as valid_active,
  count(*) filter (first_seen_at >= {TODAY} - interval 30 day) as today_new, count(*) filter (last_seen_at >= {TODAY} - interval 30 day and first_seen_at < {TODAY} - interval 30 day) as today_updated,
  count(*) filter (status = 'active') as active_total, count(*) filter (status = 'expired') as expired, count(*) filter (status = 'removed') as removed, count(*) as total,
  count(*) filter (status = 'active' and enrich_checked_at is null) as never_checked from r_jobs)""")
def _(t):
    return O.jobs_health(t.jobs, "2001-07-03 00:00:00")


@query("company_aggregates", f"select company, {AGG} from r_jobs where status = 'active' group by company")
def _(t):
    return CV.company_aggregates(t.jobs, NOW)


@query("latest_with_source", f"select s.id as source_id, s.company, r.status from ({LATEST}) r join r_sources s on s.id = r.source_id where s.enabled")
def _(t):
    r = C.latest_per_key(t.runs, ["source_id"], [F.col("started_at").desc_nulls_last(), F.col("id").desc()])
    return r.join(t.sources.where("enabled").select(F.col("id").alias("source_id"), "company"), "source_id").select("source_id", "company", "status")


@query("crawl_source_stats", f"""select *, case when success + partial_success + failed > 0 then concat(printf('%.1f', success * 100.0 / (success + partial_success + failed)), '%') else '—' end as success_rate,
  case when success + partial_success + failed > 0 then concat(printf('%.1f', partial_success * 100.0 / (success + partial_success + failed)), '%') else '—' end as partial_rate from (
  select s.id as source_id, s.company, s.adapter_name, count(r.id) as runs, count(*) filter (r.status = 'success') as success, count(*) filter (r.status = 'partial_success') as partial_success,
  count(*) filter (r.status = 'failed') as failed, count(*) filter (r.status = 'skipped') as skipped from r_sources s left join r_runs r on r.source_id = s.id and r.started_at >= {N} - {WINDOW}
  where s.enabled group by all)""")
def _(t):
    return O.crawl_source_stats(t.sources, t.runs, NOW, 400)


@query("coverage_snapshot", f"""with {SCORED} select count(*) filter (reported_total is not null) as measurable, count(*) filter (reported_total is null) as blind,
  cast(round(avg(coverage_pct) filter (reported_total > 0)) as int) as avg_coverage_pct, count(*) filter (reported_total > 0 and coverage_pct < 80) as under_count from sc""")
def _(t):
    return CV.coverage_snapshot(t.runs, t.sources)


@query("coverage_worst", f"with {SCORED} select source_id, company, fetched, reported_total, coverage_pct from sc where reported_total > 0 and coverage_pct < 80 order by coverage_pct, company, source_id limit 40")
def _(t):
    return CV.coverage_worst(t.runs, t.sources).select("source_id", "company", "fetched", "reported_total", "coverage_pct")


LISTCOV = f"""m as (select distinct p.pos, p.pattern, s.id as source_id from r_list p join r_sources s on s.company ilike p.pattern where s.enabled),
  tt as (select p.pos, p.pattern, sum(l.reported_total) as reported_total, coalesce(sum(coalesce(l.jobs_found, 0)), 0) as fetched from r_list p left join m using (pos, pattern) left join ({LATEST}) l on l.source_id = m.source_id group by all)"""


@query("match_patterns", "select p.pos, s.id as source_id from r_list p join r_sources s on s.company ilike p.pattern")
def _(t):
    return C.match_patterns(t.list.select("pos", "pattern"), "pattern", t.sources.select(F.col("id").alias("source_id"), "company"), "company").select("pos", "source_id")


@query("list_fetch_coverage", f"with {LISTCOV} select pos, cast(reported_total as int) as reported_total, cast(fetched as int) as fetched, reported_total is not null as measurable, {PCT} as coverage_pct from tt")
def _(t):
    return CV.list_fetch_coverage(t.list.select("pos", "pattern"), t.sources, t.runs).select("pos", "reported_total", "fetched", "measurable", "coverage_pct")


@query("coverage_by_industry", f"""with {LISTCOV}, sc as (select *, {PCT} as coverage_pct from tt), ind as (select distinct pattern, industry from r_list) select industry, count(*) as total, count(*) filter (reported_total is not null) as measurable,
  count(*) filter (reported_total is null) as blind, count(*) filter (coverage_pct >= 90) as fully_fetched, cast(floor(avg(coverage_pct) + 0.5) as int) as avg_pct from ind join sc using (pattern) group by industry""")
def _(t):
    dim = t.list.groupBy("pattern").agg(F.collect_set("industry").alias("industries"))
    return CV.coverage_by_industry(CV.list_fetch_coverage(t.list.select("pos", "pattern"), t.sources, t.runs), dim)


PARENT = "concat('%', cast(pos % 10 as varchar), '%') as parent_pattern"
MUST = f"""with a as (select company, {AGG} from r_jobs where status = 'active' group by company),
  d as (select p.pos, coalesce(sum(a.active_total), 0) as active_total, coalesce(sum(healthy), 0) as healthy, coalesce(sum(new_7d), 0) as new_7d, coalesce(sum(checked_72h), 0) as checked_72h from r_list p left join a on a.company ilike p.pattern group by p.pos),
  rj as (select p.pos, {AGG} from (select *, {PARENT} from r_list where pos % 3 = 0) p join r_jobs j on j.company ilike p.parent_pattern and not j.company ilike p.pattern and (contains(j.title, 'widget') or contains(lower(j.title), 'ring')) where j.status = 'active' group by p.pos),
  ok as (select * from rj where healthy >= 3)
  select d.pos, cast(d.active_total + coalesce(ok.active_total, 0) as bigint) as active_total, cast(d.healthy + coalesce(ok.healthy, 0) as bigint) as healthy, cast(d.new_7d + coalesce(ok.new_7d, 0) as bigint) as new_7d,
  cast(d.checked_72h + coalesce(ok.checked_72h, 0) as bigint) as checked_72h, cast(d.healthy as bigint) as direct_healthy, coalesce(ok.healthy, 0) as parent_healthy, coalesce(ok.healthy, 0) > 0 as via_parent from d left join ok using (pos)"""


def brand_dim(t):
    brand = F.col("pos") % 3 == 0
    return (t.list.withColumn("parent_pattern", F.when(brand, F.concat(F.lit("%"), (F.col("pos") % 10).cast("string"), F.lit("%"))))
            .withColumn("brand_tokens", F.when(brand, F.array(F.lit("widget"), F.lit("Ring")))))


@query("must_apply_coverage", MUST)
def _(t):
    return CV.must_apply_coverage(t.jobs, brand_dim(t), NOW).drop("name", "pattern")


@query("assign_owner", """select company, owner, pos from (select c.company, p.name as owner, p.pos, row_number() over (partition by c.company order by p.pos) rn
  from (select distinct company from r_posts) c join r_list p on contains(lower(c.company), lower(p.needle))) where rn = 1""")
def _(t):
    return CV.assign_owner(t.posts.select("company").distinct(), t.list)


BOARDQ = """case when adapter_name in ('tencent', 'baidu', 'wt', 'beisen') then 'mixed' when contains(lower(source_url), 'off-campus') then 'social' when regexp_matches(lower(source_url), 'campus|/school|university|xiaozhao') then 'campus' when regexp_matches(lower(source_url), 'intern|shixi') then 'intern' else 'social' end"""


@query("source_flags", f"""select p.pos, p.name, count(s.id) > 0 as has_any, coalesce(bool_or(s.enabled), false) as has_enabled, coalesce(bool_or(s.enabled and {BOARDQ} in ('campus', 'mixed')), false) as has_campus
  from r_list p left join r_sources s on s.company ilike p.pattern group by p.pos, p.name""")
def _(t):
    s = t.sources.withColumn("board", U.source_board("adapter_name", "source_url"))
    return CV.source_flags(t.list, s)


LEDGER = "select pattern, ['healthy', 'thin_only', 'no_active_jobs', 'anti_bot', 'login_wall', 'manual_review'][min(pos) % 6 + 1] as state, cast(min(pos) % 4 as int) as attempts"


@query("gap_census", f"""with a as (select company, {AGG} from r_jobs where status = 'active' group by company) select p.pos, case when coalesce(sum(a.healthy), 0) > 0 then 'healthy' when coalesce(sum(a.active_total), 0) > 0 then 'thin_only'
  when (select bool_or(s.enabled) from r_sources s where s.company ilike p.pattern) then 'no_active_jobs' when min(v.state) not in ('healthy', 'thin_only', 'no_active_jobs') then min(v.state) else 'unknown' end as state, any_value(coalesce(v.attempts, 0)) as attempts, cast(coalesce(sum(a.active_total), 0) as bigint) as active_total from r_list p left join a on a.company ilike p.pattern left join ({LEDGER} from r_list group by pattern) v on v.pattern = p.pattern group by p.pos, p.pattern""")
def _(t):
    dim = t.list.withColumn("parent_pattern", F.lit(None).cast("string")).withColumn("brand_tokens", F.array().cast("array<string>"))
    s = t.sources.withColumn("board", U.source_board("adapter_name", "source_url"))
    first = t.list.groupBy("pattern").agg(F.min("pos").alias("pos"))
    state = F.element_at(F.array(*map(F.lit, ("healthy", "thin_only", "no_active_jobs", "anti_bot", "login_wall", "manual_review"))), (F.col("pos") % 6 + 1).cast("int"))
    prev = first.select("pattern", state.alias("state"), (F.col("pos") % 4).cast("int").alias("attempts"))
    return CV.gap_census(t.jobs, s, dim, prev, NOW).select("pos", "state", "attempts", "active_total")


@query("gap_ledger", f"""with a as (select company, {AGG} from r_jobs where status = 'active' group by company), v as ({LEDGER}, min(pos) as p from r_list group by pattern),
  c as (select p.pos, p.name, p.pattern, coalesce(sum(a.healthy), 0)::bigint as healthy, coalesce(sum(a.active_total), 0)::bigint as total, coalesce(list_sort(list_distinct(list(a.company) filter (a.company is not null and a.company <> ''))), []) as companies from r_list p left join a on a.company ilike p.pattern group by p.pos, p.name, p.pattern),
  s as (select p.pos, list_transform(list_sort(list(s.id)), lambda x: cast(x as varchar)) as ids, min(s.id) filter (s.enabled) as on_ from r_list p join r_sources s on s.company ilike p.pattern group by p.pos),
  r as (select c.*, v.p, v.attempts, coalesce(s.ids, []) as ids, s.on_, case when healthy > 0 then 'healthy' when total > 0 then 'thin_only' when s.on_ is not null then 'no_active_jobs' when v.state not in ('healthy', 'thin_only', 'no_active_jobs') then v.state else 'unknown' end as state from c left join s using (pos) left join v using (pattern))
  select pos, name, pattern, state, case when on_ is not null then cast(on_ as varchar) when state <> 'unknown' then 'p' || p end as source_id, case when p % 2 = 0 then 'https://e/' || p end as official_entry_url, case when state <> 'healthy' then 'why' || p % 3 end as fail_reason, attempts, p % 4 as rounds_no_entry,
    '{{' || case when p % 3 = 0 then '"note":{{"k":[1,null]}},' else '' end || '"active_jobs":' || total || ',"covered_via_parent_portal":false,"direct_healthy_jobs":' || healthy || ',"healthy_jobs":' || healthy || ',"list_version":"v7","matched_job_companies":' || cast(to_json(companies) as varchar)
      || ',"matched_source_ids":' || cast(to_json(ids) as varchar) || ',"parent_portal_healthy_jobs":0}}' as evidence,
    case when state = 'healthy' then null when state in ('thin_only', 'no_active_jobs') and p % 5 <> 0 then timestamp '{NOW}' when p % 5 = 0 then timestamp '2002-01-01' end as next_retry_at from r""")
def _(t):
    dim = t.list.withColumn("parent_pattern", F.lit(None).cast("string")).withColumn("brand_tokens", F.array().cast("array<string>"))
    s = t.sources.withColumn("board", U.source_board("adapter_name", "source_url"))
    p = t.list.groupBy("pattern").agg(F.min("pos").alias("p"))
    state = F.element_at(F.array(*map(F.lit, ("healthy", "thin_only", "no_active_jobs", "anti_bot", "login_wall", "manual_review"))), (F.col("p") % 6 + 1).cast("int"))
    old = F.expr("""case when p % 3 = 0 then '{"note": {"k": [1, null]}, "active_jobs": 99}' when p % 3 = 1 then 'broken' end""")
    prev = p.select("pattern", state.alias("state"), (F.col("p") % 4).cast("int").alias("attempts"), (F.col("p") % 4).cast("int").alias("rounds_no_entry"), F.concat(F.lit("p"), "p").alias("source_id"), F.expr("case when p % 2 = 0 then concat('https://e/', p) end").alias("official_entry_url"),
                    F.lit(None).cast("string").alias("detected_platform"), F.concat(F.lit("why"), F.col("p") % 3).alias("fail_reason"), old.alias("evidence"), F.lit(None).cast("timestamp").alias("last_attempt_at"), F.expr("case when p % 5 = 0 then timestamp '2002-01-01' end").alias("next_retry_at"))
    rows = CV.gap_ledger(t.jobs, s, dim, prev, NOW, "v7")
    told = F.from_json("evidence", "map<string,variant>")
    # keys in a fixed order: the merged note first, then the census keys
    keys = F.sort_array(F.map_keys(told))
    ordered = F.concat(F.filter(keys, lambda k: k == "note"), F.filter(keys, lambda k: k != "note"))
    text = F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.to_json(F.element_at(told, k)))), ","), F.lit("}"))
    return rows.select("pos", "name", "pattern", "state", "source_id", "official_entry_url", "fail_reason", "attempts", "rounds_no_entry", text.alias("evidence"), "next_retry_at")


@query("industry_coverage", "select industry, count(*) as total, count(*) filter (enabled) as healthy, count(*) filter (enabled) * 1.0 / count(*) as ratio from r_sources group by industry")
def _(t):
    rows = t.sources.select(F.array("industry").alias("industries"), F.when(F.col("enabled"), "healthy").otherwise("gap").alias("state"))
    return CV.industry_coverage(rows)


@query("channel_coverage", "select segment, industry, count(*) as total, count(*) filter (enabled) as enabled from r_sources group by rollup (segment, industry)")
def _(t):
    return CV.channel_coverage(t.sources)


@query("link_by_company_key", """select c_custkey as user_id, list_aggregate(list_sort(list_distinct(list(s.id) filter (s.id is not null))), 'string_agg', ',') as ids from (select c_custkey, concat('SUPPLIER#', lpad(cast(c_custkey % 150 as varchar), 9, '0'), '有限公司') as company from customer) w
  left join r_sources s on s.enabled and lower(s.company) = lower(replace(w.company, '有限公司', '')) group by c_custkey""")
def _(t):
    w = t.customer.select(F.col("c_custkey").alias("user_id"), F.expr("concat('SUPPLIER#', lpad(c_custkey % 150, 9, '0'), '有限公司')").alias("company"))
    out = CV.link_by_company_key(w, t.sources)
    return out.select("user_id", F.when(F.size("matched_source_ids") > 0, F.array_join("matched_source_ids", ",")).alias("ids"))


@query("watch_queue", """select normalized, requesters, status, company, case status when 'pending' then 0 when 'in_progress' then 1 when 'covered' then 2 else 3 end as rank from (select lower(c) as normalized, count(distinct u) as requesters, arg_max(st, (ts, id)) as status, arg_min(c, (ts, id)) as company from (
  select user_id as u, ts, event_id as id, concat(case event_type when 'view' then 'Acme' else 'Beta' end, cast(user_id % 20 as varchar)) as c, case cast(floor(value) as int) % 4 when 0 then 'pending' when 1 then 'in_progress' when 2 then 'covered' else 'rejected' end as st from events) group by 1)""")
def _(t):
    r = t.base("events").select("user_id", F.col("ts").alias("created_at"), F.col("event_id").alias("id"),
                                F.expr("concat(case event_type when 'view' then 'Acme' else 'Beta' end, user_id % 20)").alias("company"),
                                F.expr("case cast(floor(value) as int) % 4 when 0 then 'pending' when 1 then 'in_progress' when 2 then 'covered' else 'rejected' end").alias("status"))
    return CV.watch_queue(r.withColumn("normalized", F.lower("company"))).select("normalized", "requesters", "status", "company", "rank")


@query("company_covered", "select s_name as company, s_suppkey % 3 <> 2 as covered from supplier")
def _(t):
    have = t.supplier.select(F.expr("case s_suppkey % 3 when 0 then concat(s_name, '股份有限公司') when 1 then concat('北京', s_name, '科技') else concat('甲乙', s_name) end").alias("company"))
    return CV.company_covered(t.supplier.select(F.col("s_name").alias("company")), have)


@query("missing_sources", "select s_suppkey as id from supplier where s_suppkey not in (select id from r_sources where enabled)")
def _(t):
    return C.missing_from(t.supplier.select(F.col("s_suppkey").alias("id")), t.sources.where("enabled"), "id")


DAYS = f"{N} - interval 120 day"


@query("crawl_today", f"""select count(*) as runs, coalesce(sum(jobs_found), 0)::bigint as jobs_found, coalesce(sum(jobs_created), 0)::bigint as jobs_created, coalesce(sum(jobs_updated), 0)::bigint as jobs_updated, count(*) filter (status = 'failed') as failed_runs,
  count(distinct source_id) filter (status = 'failed') as failed_sources, strftime(max(coalesce(finished_at, started_at)), '%Y-%m-%d %H:%M') as last_run_at from r_runs where started_at >= timestamp '2001-07-31 16:00:00'""")
def _(t):
    return O.crawl_today(t.runs, "2001-08-01 00:00:00").withColumn("last_run_at", F.date_format("last_run_at", "yyyy-MM-dd HH:mm"))


@query("discovery_today", """select count(*) as runs, coalesce(sum(jobs_created), 0)::bigint as jobs_created, coalesce(sum(jobs_updated), 0)::bigint as jobs_updated, count(*) filter (status = 'failed') as failed_runs from r_runs where created_at >= timestamp '2001-07-31 16:00:00'""")
def _(t):
    return O.discovery_today(t.runs, "2001-08-01 00:00:00").drop("last_run_at")


@query("ops_today", """select module, count(*) as runs, count(*) filter (status = 'success') as success, count(*) filter (status = 'partial') as partial, count(*) filter (status = 'failed') as failed,
  coalesce(sum(case when json_type(metrics, '$.added') in ('UBIGINT', 'BIGINT') then cast(metrics->>'$.added' as int) else 0 end), 0)::bigint as added, coalesce(sum(cast(metrics->>'$.seen' as int)), 0)::bigint as seen
  from r_ops where cast(created_at + interval 8 hours as date) = date '2024-01-30' group by module""")
def _(t):
    return O.ops_today(t.ops, "2024-01-30 00:00:00", ["added", "seen"]).drop("last_run_at")


@query("discovery_modes", f"""select coalesce(mode, 'web_search') as mode, count(*) as runs, count(*) filter (finished_at is not null) as completed_runs, round(avg(epoch(finished_at) - epoch(started_at)), 1) as avg_seconds from r_runs where created_at >= {DAYS} group by 1""")
def _(t):
    return O.discovery_modes(t.runs, at(NOW) - F.expr("interval 120 days"))


@query("discovery_failures", f"""select coalesce(mode, 'web_search') as mode, coalesce(nullif(trim(error_message), ''), case when status = 'partial_success' then 'partial_success_unspecified' else 'unknown' end) as reason, count(*) as n
  from r_runs where created_at >= {DAYS} and status in ('failed', 'partial_success') group by all""")
def _(t):
    r = t.runs.withColumn("failure_reason", F.col("error_message")).withColumn("diagnostics", F.lit("{}"))
    return O.discovery_failures(r, at(NOW) - F.expr("interval 120 days"))


@query("insight_totals", """select concat('dimension:', lang) as figure, count(*) as n from r_subs where status = 'approved' group by lang union all select 'disputes_total', count(*) from r_subs where status <> 'approved'
  union all select 'disputes_open', count(*) from r_subs where status = 'pending'""")
def _(t):
    items = t.subs.select(F.col("lang").alias("dimension"), F.when(F.col("status") == "approved", "active").otherwise("retired").alias("status"))
    disputes = t.subs.where("status <> 'approved'").select(F.when(F.col("status") == "pending", "open").otherwise("closed").alias("status"))
    return O.insight_totals(items, disputes)


@query("user_funnel", f"""select (select count(*) from customer) as total_users, (select count(distinct user_id) from r_prefs where role <> '') as users_with_preferences, count(distinct user_id) filter (action = 'saved') as saved_users, count(distinct user_id) filter (action = 'applied') as applied_users,
  count(*) filter (action = 'saved') as saved_total, count(*) filter (action = 'saved' and created_at >= {ETODAY}) as saved_today, count(*) filter (action = 'applied') as applied_total, count(*) filter (action = 'applied' and created_at >= {ETODAY}) as applied_today from r_actions""")
def _(t):
    return O.user_funnel(t.customer, t.prefs.where("role <> ''"), t.actions, EVENTS_NOW)


RES = "case when event = 'resume_parse' and cast(id as int) % 2 = 0 then 'resume_parse_succeeded' when event = 'resume_parse' then 'resume_parse_started' when event = 'apply_open' then 'opportunity_official_opened' when event = 'job_click' then 'job_liveness_at_click' else event end"


def named_events(t):
    return t.tracks.withColumn("event", F.expr(RES)).withColumn("payload", F.regexp_replace("payload", '"rules"', '"rule"'))


@query("resume_today", f"""select count(*) filter (e = 'resume_parse_started') as started, count(*) filter (e = 'resume_parse_succeeded') as succeeded, count(*) filter (e = 'resume_parse_succeeded' and payload->>'$.diagnostics.source' = 'llm') as llm,
  count(*) filter (e = 'resume_parse_succeeded' and payload->>'$.diagnostics.source' = 'rules') as rule from (select *, {RES} as e from r_tracks) where created_at >= timestamp '2024-01-19 16:00:00'""")
def _(t):
    return O.resume_today(named_events(t), "2024-01-20 00:00:00")


CLICKS = f"(select payload->>'$.result' as result, payload->>'$.adapter' as adapter, {RES} as e from r_tracks)"


@query("click_validity", f"""select *, alive / (alive + dead) as validity_rate, (alive + dead) / opens as coverage_rate, unknown / probes as unknown_rate from (select count(*) filter (e = 'opportunity_official_opened') as opens, count(*) filter (e = 'job_liveness_at_click') as probes,
  count(*) filter (e = 'job_liveness_at_click' and result = 'alive') as alive, count(*) filter (e = 'job_liveness_at_click' and result = 'dead') as dead, count(*) filter (e = 'job_liveness_at_click' and result not in ('alive', 'dead')) as unknown from {CLICKS})""")
def _(t):
    return O.click_validity(named_events(t))


@query("click_validity_by_adapter", f"select *, alive / (alive + dead) as validity_rate from (select adapter, count(*) filter (result = 'alive') as alive, count(*) filter (result = 'dead') as dead, count(*) filter (result not in ('alive', 'dead')) as unknown from {CLICKS} where e = 'job_liveness_at_click' group by adapter)")
def _(t):
    return O.click_validity_by_adapter(named_events(t))


@query("event_counts", f"select event, count(*) as n from r_tracks where created_at >= {EN} - interval 7 day group by event")
def _(t):
    return O.event_counts(t.tracks, at(EVENTS_NOW) - F.expr("interval 7 days"))


@query("supply_ledger", """with o as (select *, cast(created_at + interval 8 hours as date) as d from r_ops where module = 'gap_funnel'), l as (select * from o where d = (select max(d) from o) order by created_at desc, id desc limit 1)
  select cast(case when json_type(metrics, '$.added') in ('UBIGINT', 'BIGINT') then cast(metrics->>'$.added' as int) end as bigint) as real_expansion, (select count(*) from r_list where pos % 4 = 1) as definition_change from l""")
def _(t):
    ops = t.ops.withColumn("metrics", F.replace(F.col("metrics"), F.lit('"added"'), F.lit('"sources_added"')))
    cov = t.list.select((F.col("pos") % 2 == 1).alias("via_parent"), F.when(F.col("pos") % 4 == 1, 0).otherwise(2).alias("direct_healthy"))
    return O.supply_ledger(ops, cov)


@query("gap_summary", """with a as (select s_name as company, case s_suppkey % 5 when 0 then 'anti_bot' when 1 then 'login_wall' when 2 then 'healthy' when 3 then null else 'unreachable' end as state, case when s_suppkey % 3 = 0 then 'timeout' else ' ' end as why, s_acctbal, case when s_suppkey % 2 = 0 then 1 end as retry from supplier)
  select 'state' as kind, coalesce(state, 'unknown') as label, count(*) as n from a group by 2 union all select * from (select 'failure', company, 1 from a where trim(why) <> '' order by s_acctbal desc, company limit 5) union all select 'manual', company, 1 from a where state in ('anti_bot', 'login_wall') and retry is null""")
def _(t):
    a = t.supplier.select(F.col("s_name").alias("company"), F.expr("case s_suppkey % 5 when 0 then 'anti_bot' when 1 then 'login_wall' when 2 then 'healthy' when 3 then null else 'unreachable' end").alias("state"),
                          F.expr("case when s_suppkey % 3 = 0 then 'timeout' else ' ' end").alias("fail_reason"), F.col("s_acctbal").alias("last_attempt_at"),
                          F.expr("case when s_suppkey % 2 = 0 then 1 end").alias("next_retry_at"))
    return O.gap_summary(a)


@query("daily_reports", """with o as (select case module when 'enrich' then 'enrichment' when 'gap_funnel' then 'dead_jobs' when 'insight' then 'insights' when 'discover' then 'auto_discover' end as report, count(*) as runs, count(*) filter (status = 'failed') as failed from r_ops where cast(created_at + interval 8 hours as date) = date '2024-01-30' group by 1),
  c as (select count(*) as runs, count(*) filter (status = 'failed') as failed from r_runs where started_at >= timestamp '2001-07-31 16:00:00'), u as (select 'crawl' as report, runs, failed from c union all select 'discovery', runs, failed from c union all select report, runs, failed from o where report is not null)
  select report, cast(runs as bigint) as runs, cast(failed as bigint) as failed, case when runs <= 0 then 'idle' when failed >= runs then 'failed' else 'success' end as status from u""")
def _(t):
    ops = O.ops_today(t.ops, "2024-01-30 00:00:00", [])
    mods = {"enrichment": ["enrich"], "dead_jobs": ["gap_funnel"], "insights": ["insight"], "auto_discover": ["discover"]}
    return O.daily_reports(O.crawl_today(t.runs, "2001-08-01 00:00:00"), O.discovery_today(t.runs, "2001-08-01 00:00:00"), ops, mods).drop("last_run_at")


@query("budget_status", """select event_type as provider, 80 as cap, used, greatest(0, 80 - used) as remaining, used >= 80 as exhausted from (select event_type, count(*) filter (cast(ts + interval 8 hours as date) = date '2024-01-30') as used from events group by event_type)""")
def _(t):
    e = t.base("events")
    usage = e.select(F.col("event_type").alias("provider"), F.lit(1).alias("calls"), F.col("ts").alias("created_at"))
    caps = e.select(F.col("event_type").alias("provider")).distinct().withColumn("cap", F.lit(80))
    return O.budget_status(usage, caps, "2024-01-30 00:00:00")


@query("reconcile", "select source_id, n as want_n, case when source_id % 10 = 0 then n + 1 else n end as got_n from (select source_id, count(*) as n from r_runs group by source_id) where source_id % 10 = 0")
def _(t):
    a = t.runs.groupBy("source_id").agg(F.count("*").alias("n"))
    b = a.withColumn("n", F.expr("case when source_id % 10 = 0 then n + 1 else n end"))
    return O.reconcile(a, b, ["source_id"], ["n"])


@query("crawl_summary", "select count(*) filter (status = 'success') as success, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'success' and jobs_found = 0) as empty, sum(jobs_created)::bigint as created, sum(jobs_updated)::bigint as updated from r_runs")
def _(t):
    return O.crawl_summary(t.runs)


@query("ops_run_rows", "select id, case when failed > 0 and done = 0 then 'failed' when failed > 0 then 'partial' else 'success' end as status, strftime(ts + interval 8 hours, '%Y-%m-%d') as run_date from (select event_id as id, cast(floor(value) as int) % 3 as failed, user_id % 2 as done, ts from events)")
def _(t):
    s = t.base("events").select(F.col("event_id").alias("id"), F.expr("cast(floor(value) as int) % 3").alias("failed"), F.expr("user_id % 2").alias("done"), F.col("ts").alias("finished_at"))
    return O.ops_run_rows(s).select("id", "status", F.col("run_date").cast("string").alias("run_date"))


@query("adapter_breaker", """with c as (select event_id, user_id % 4 as adapter, count(*) over w as seen, sum(case when value < 50 or event_type = 'view' then 1 else 0 end) over w as misses from events window w as (partition by user_id % 4 order by ts, event_id rows unbounded preceding))
  select adapter, min(seen) as seen from c where seen >= 50 and misses >= seen * 0.7 group by adapter""")
def _(t):
    c = t.base("events").select(F.expr("user_id % 4").alias("adapter"), F.col("ts").alias("checked_at"), F.col("event_id").alias("id"), F.expr("value < 50 or event_type = 'view'").alias("miss"))
    return O.adapter_breaker(c).select("adapter", "seen")


@query("ops_dashboard")
def _(t):
    return O.ops_dashboard(t.jobs, t.sources, t.runs, t.runs, t.ops, named_events(t), t.customer, t.prefs, t.actions, NOW)


@query("health_verdict")
def _(t):
    cov = CV.coverage_snapshot(t.runs, t.sources).select(F.col("avg_coverage_pct").alias("coverage_pct"), F.col("blind").alias("blind_sources"), F.lit(1).alias("k"))
    clicks = O.click_validity(named_events(t)).select(F.col("validity_rate").alias("click_rate"), F.lit(1).alias("k"))
    health = O.jobs_health(t.jobs, NOW).select("valid_active", F.lit(1).alias("k"))
    crawl = O.crawl_today(t.runs, NOW).select(F.col("runs").alias("crawl_runs"), F.col("failed_runs").alias("crawl_failed"), F.lit(1).alias("k"))
    dim = brand_dim(t)
    must = CV.must_apply_coverage(t.jobs, dim, NOW).agg(
        F.count_if(F.col("healthy") > 0).alias("healthy_companies"), F.count("*").alias("total_companies"),
        F.array_sort(F.collect_list(F.when(F.col("healthy") == 0, F.col("name")))).alias("zero_companies"),
        F.array_sort(F.collect_list(F.when((F.col("healthy") > 0) & (F.col("checked_72h") == 0), F.col("name")))).alias("blind_companies")).withColumn("k", F.lit(1))
    return O.health_verdict(cov.join(clicks, "k").join(health, "k").join(crawl, "k").join(must, "k").drop("k"))


@query("user_industry", "select industry, job_scope, count(*) as users from (select industry, job_scope from r_prefs where job_scope <> 'all' union all select industry, 'domestic' from r_prefs where job_scope = 'all' union all select industry, 'overseas' from r_prefs where job_scope = 'all') group by all")
def _(t):
    scope = F.expr("case job_scope when 'all' then array('domestic', 'overseas') else array(job_scope) end")
    return t.prefs.select(F.explode(F.array("industry")).alias("industry"), scope.alias("scopes")).select(
        "industry", F.explode("scopes").alias("job_scope")).groupBy("industry", "job_scope").agg(F.count("*").alias("users"))
