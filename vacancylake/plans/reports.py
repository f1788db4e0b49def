"""Insights, campus, queues, audits and validation over whole tables."""
from pyspark.sql import functions as F

from ..functions import fixed as V, text as T, urls as U
from ..functions.base import at
from ..operators import audit as A, campus as CA, core as C, coverage as CV, insights as IN, queues as QU, validate as VA
from . import sqlgen as S
from .basics import canon
from .columns import BUCKET, CATEGORY, CITYHEAD, COARSE
from .registry import query
from .roles import EVENTS_NOW, NOW

N = f"timestamp '{NOW}'"
EN = f"timestamp '{EVENTS_NOW}'"


@query("salary_band", f"select company, sample, cast(floor(lo + 0.5) as int) as min_k, cast(floor(hi + 0.5) as int) as max_k from (select company, count(*) as sample, quantile_cont(m.lo, 0.5) as lo, quantile_cont(m.hi, 0.5) as hi from (select company, {S.monthly('salary_text')} as m from r_posts where status = 'active') where m is not null group by company) where sample >= 5")
def _(t):
    return IN.salary_band(t.posts)


@query("hiring_timing", f"""with r as (select company, {BUCKET} as bucket, month(coalesce(posted_at, first_seen_at)) as m from r_posts), d as (select company, count(*) as dated from r group by 1), p as (select company, bucket, m, count(*) as n from r where bucket <> 'unknown' group by all),
  k as (select *, row_number() over (partition by company, bucket order by n desc, m) as rk, sum(n) over (partition by company, bucket) as total, count(*) over (partition by company, bucket) as months from p)
  select company, bucket, dated, case when bucket = 'social' and max(months) >= 6 then 'rolling' else string_agg(cast(m as varchar), '、' order by m) end as peaks from k join d using (company) where rk <= 2 and total >= 3 and dated >= 5 group by company, bucket, dated""")
def _(t):
    return IN.hiring_timing(t.posts)


@query("trend_pct", "select company, recent, prior, case when prior >= 3 then cast(floor((recent - prior) / prior * 100 + 0.5) as int) end as trend from (select company, count(*) filter (first_seen_at >= timestamp '2001-07-03') as recent, count(*) filter (first_seen_at >= timestamp '2001-06-03' and first_seen_at < timestamp '2001-07-03') as prior from r_posts group by company)")
def _(t):
    return IN.trend_pct(t.posts, NOW)


@query("hiring_snapshot", f"""with j as (select company, {CITYHEAD} as city, {COARSE} as fn, {BUCKET} as bucket from r_posts where status = 'active'), b as (select company, count(*) as active_count, count(*) filter (bucket = 'campus') as campus, count(*) filter (bucket = 'intern') as intern, count(*) filter (bucket = 'social') as social, count(*) filter (bucket = 'unknown') as unknown from j group by 1),
  c as (select company, string_agg(concat(city, ':', cast(n as varchar)), ',' order by rk) as top_cities from (select company, city, count(*) as n, row_number() over (partition by company order by count(*) desc, city) rk from j where city is not null group by company, city) where rk <= 3 group by 1),
  f as (select company, string_agg(concat(fn, ':', cast(n as varchar)), ',' order by rk) as top_functions from (select company, fn, count(*) as n, row_number() over (partition by company order by count(*) desc, fn) rk from j where fn <> '其他' group by company, fn) where rk <= 3 group by 1)
  select * from b left join c using (company) left join f using (company) where active_count >= 3""")
def _(t):
    return IN.hiring_snapshot(t.posts)


@query("hiring_monthly", "select company, strftime(first_seen_at, '%Y-%m') as month, count(*) as postings, count(*) filter (status = 'active') as active from r_posts group by all")
def _(t):
    return IN.hiring_monthly(t.posts)


@query("company_insights")
def _(t):
    bands = t.sources.select("company", F.expr("case id % 3 when 0 then '1-100' when 1 then '1000-5000' else '10万+' end").alias("band"))
    return IN.company_insights(t.posts, NOW, bands)


@query("hiring_signal", "select s_suppkey as id, case when t >= 25 then 'expanding' when t <= -25 then 'tightening' else 'steady' end as momentum, case when n > 0 then case when n / 3000 >= 0.015 then 'high' when n / 3000 >= 0.004 then 'mid' else 'low' end end as intensity from (select s_suppkey, s_suppkey % 90 - 45 as t, s_suppkey % 60 as n from supplier)")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.expr("s_suppkey % 90 - 45").alias("t"), F.expr("s_suppkey % 60").alias("n"), F.lit("1000-5000").alias("band"))
    h = IN.hiring_signal("n", "t", "band")
    return s.select("id", h["momentum"].alias("momentum"), h["intensity"].alias("intensity"))


@query("first_party", "select company, count(*) as count, round(avg(rating), 1) as average_rating, count(*) >= 5 as visible from r_subs where status = 'approved' group by company")
def _(t):
    return IN.first_party(t.subs)


@query("insight_gate", """select id, v and not old as displayable, v and old as outdated from (select c.id, c.verify_status = 'verified' and c.id % 3 <> 1 and (case when c.id % 2 = 0 then true else c.id % 7 >= 5 and true end) and not (c.id % 5 = 0) as v, coalesce(valid_until < date '2000-01-01', false) as old from r_claims c)""")
def _(t):
    c = t.claims
    items = c.select("id", F.expr("case verify_status when 'verified' then 'active' else 'draft' end").alias("status"), F.lit(True).alias("deidentified"), F.expr("case when id % 2 = 0 then 'fact' else 'experience' end").alias("grade"),
                     F.expr("id % 7").alias("sample_size"), F.expr("case when id % 5 = 0 then '据反馈 平台认定' else '据 3 位网友反馈' end").alias("content"), F.lit("2026").alias("time_window"), F.lit(None).cast("date").alias("valid_from"), "valid_until")
    links = c.select(F.col("id").alias("item_id"), F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("insight_source_id"))
    src = links.select(F.col("insight_source_id").alias("id"), F.lit("https://x").alias("url"), F.expr("concat('p', insight_source_id % 2)").alias("publisher"), F.expr("item_id % 3 <> 1").alias("deidentified"))
    return IN.insight_gate(IN.items_with_sources(items, links, src), "2000-01-01").select("id", "displayable", "outdated")


@query("match_profile", "select s_name as company, s_suppkey % 40 as profile_id, case when s_suppkey % 2 = 0 then 0 else 1 end as how from supplier")
def _(t):
    names = t.supplier.select(F.col("s_name").alias("company"))
    prof = t.supplier.select(F.col("s_suppkey").cast("int").alias("pos"), (F.col("s_suppkey") % 40).alias("profile_id"),
        F.expr("case when s_suppkey % 2 = 0 then concat(s_name, ' Inc.') else concat('甲', s_name, '乙') end").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return IN.match_profile(names, prof).select("company", "profile_id", "how")


@query("counts_by_profile", "select s_suppkey as profile_id, coalesce(n, 0) as active, coalesce(n, 0) >= 3 as available from supplier left join (select company, count(*) as n from r_posts where status = 'active' group by 1) on company = s_name")
def _(t):
    counts = t.posts.where("status = 'active'").groupBy(F.concat("company", F.lit("有限公司")).alias("company")).agg(F.count("*").alias("job_count"))
    prof = t.supplier.select(F.col("s_suppkey").cast("int").alias("pos"), F.col("s_suppkey").alias("profile_id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return IN.counts_by_profile(counts, prof)


@query("claim_status", "select id, case when id % 4 < (case when id % 2 = 0 then 1 else 2 end) then 'drop' when id % 3 = 0 then 'drop' when id % 10 >= 6 then 'active' when id % 10 >= 4 then 'pending_review' else 'drop' end as status from r_claims")
def _(t):
    c = t.claims.select("id", F.expr("case when id % 3 = 0 then 'neutral' else 'entailment' end").alias("verdict"), (F.col("id") % 10 / 10).alias("confidence"), F.expr("case when id % 2 = 0 then 'fact' else 'experience' end").alias("grade"), (F.col("id") % 4).alias("n_publishers"))
    return IN.claim_status(c).select("id", "status")


@query("retire_generation", """select id, case when verify_status = 'verified' and id % 4 <> 0 and date_start < max(date_start) over (partition by company_id) and company_id % 5 <> 0 then 'retired'
  when verify_status = 'verified' then 'active' else 'draft' end as status from r_claims""")
def _(t):
    items = t.claims.select("id", "company_id", F.expr("case verify_status when 'verified' then 'active' else 'draft' end").alias("status"),
                            F.expr("case when id % 4 = 0 then 'first_party' else 'public_web' end").alias("origin"), F.col("date_start").cast("timestamp").alias("last_verified_at"))
    runs = items.groupBy("company_id").agg(F.max("last_verified_at").alias("run_start"), (F.first("company_id") % 5 != 0).alias("wrote_any"))
    return IN.retire_generation(items, runs).select("id", "status")


@query("pick_evidence", "with r as (select company_id as claim_id, publisher, id % 11 = 0 as cited, id as pos from r_claims), p as (select * from (select *, row_number() over (partition by claim_id, publisher order by cited desc, pos) rn from r) where rn = 1) select claim_id, publisher, pos from (select *, row_number() over (partition by claim_id order by cited desc, pos) k from p) where k <= 3")
def _(t):
    r = t.claims.select(F.col("company_id").alias("claim_id"), "publisher", (F.col("id") % 11 == 0).alias("cited"), F.col("id").alias("pos"))
    return IN.pick_evidence(r).select("claim_id", "publisher", "pos")


@query("annual_financials", "with y as (select s_nationkey as company, s_suppkey as fiscal_end, s_acctbal as value, lag(s_acctbal) over (partition by s_nationkey order by s_suppkey) as prev, row_number() over (partition by s_nationkey order by s_suppkey desc) rn from supplier) select company, fiscal_end, value, prev, case when prev <> 0 then round_even((value - prev) / abs(prev) * 100, 1) end as yoy_pct from y where rn = 1")
def _(t):
    f = t.supplier.select(F.col("s_nationkey").alias("company"), F.lit("revenue").alias("metric"), F.col("s_suppkey").alias("fiscal_end"), F.col("s_acctbal").alias("value"))
    return IN.annual_financials(f).select("company", "fiscal_end", "value", "prev", "yoy_pct")


# --- campus ---

SUR = "(select *, lag(campus_count) over (partition by source_id order by captured_at) as prev_count from r_snaps)"


@query("surges", f"select source_id, strftime(captured_at, '%Y-%m') as month, coalesce(campus_count > prev_count and ((prev_count > 0 and campus_count >= prev_count * 3) or campus_count >= prev_count + 50), false) as surge from {SUR}")
def _(t):
    return CA.surges(t.snaps).select("source_id", F.date_format("captured_at", "yyyy-MM").alias("month"), "surge")


@query("recent_surges", f"""with s as (select u.*, s.s_name as company from (select *, coalesce(campus_count > prev_count and ((prev_count > 0 and campus_count >= prev_count * 3) or campus_count >= prev_count + 50), false) as surge from {SUR}) u join supplier s on s.s_suppkey = u.source_id)
  select p.pos, arg_max(campus_count, (captured_at, source_id)) as campus_count from s join r_list p on contains(lower(s.company), lower(p.needle)) where surge and captured_at >= timestamp '1999-01-01' group by p.pos""")
def _(t):
    snaps = CA.surges(t.snaps).join(t.sources.select(F.col("id").alias("source_id"), "company"), "source_id")
    return CA.recent_surges(t.list, snaps, "2001-09-27 00:00:00", 1000).select("pos", "campus_count")


@query("campus_counts", "select source_id, count(*) as campus_count from r_posts where status = 'active' and (regexp_matches(coalesce(job_type, ''), '校|应届|campus|Campus|graduate|Graduate') or regexp_matches(title, '校招|校园招聘|应届|秋招|春招')) group by source_id")
def _(t):
    return CA.campus_counts(t.posts)


@query("campus_sources", """select s.id from r_sources s where enabled and (adapter_name = 'beisen' or contains(source_url, '/campus/') or exists (select 1 from r_posts j where j.source_id = s.id and first_seen_at >= timestamp '2001-07-31' and (regexp_matches(coalesce(job_type, ''), '校') or regexp_matches(title, '校园招聘'))))""")
def _(t):
    s = t.sources.withColumn("board", U.source_board("adapter_name", "source_url"))
    return CA.campus_sources(s, CA.campus_producers(t.posts, NOW, 2)).select("id")


@query("campus_zone", f"""with j as (select *, {CATEGORY} as cat from (select *, cast(null as varchar) as summary, case when contains(title, '2027届') then 1999 end as grad_class from r_posts where status = 'active' and (regexp_matches(coalesce(job_type, ''), '(?i)校|实习|intern') or regexp_matches(title, '(?i)校|届|graduate|实习|intern') or regexp_matches(jd_url, '/campus/')))),
  o as (select company, pos from (select c.company, p.pos, row_number() over (partition by c.company order by p.pos) rn from (select distinct company from j) c join r_list p on contains(lower(c.company), lower(p.needle))) where rn = 1)
  select p.pos, count(*) filter (cat = '校招' and grad_class is null) as campus_jobs, count(*) filter (cat = '实习' and grad_class is null) as intern_jobs, count(*) filter (cat in ('校招', '实习') and grad_class is not null) as past_class from r_list p left join (j join o using (company)) on o.pos = p.pos group by p.pos""")
def _(t):
    j = t.posts.withColumn("summary", F.lit(None).cast("string")).withColumn("experience", F.lit(None).cast("string")).withColumn("grad_class", F.expr("case when contains(title, '2027届') then 1999 end"))
    return CA.campus_zone(j, t.list, NOW).select("pos", "campus_jobs", "intern_jobs", "past_class")


@query("campus_page")
def _(t):
    j = t.jobs.withColumn("grad_class", T.grad_class("title", "job_type", "summary"))
    return CA.campus_page(j, t.list, t.sources.withColumn("board", U.source_board("adapter_name", "source_url")), NOW)


@query("group_by_city", "select coalesce(nullif(trim(location), ''), '其他') as city, count(*) as n from r_posts group by 1")
def _(t):
    return CA.group_by_city(t.posts)


def obs(t):
    return t.claims.select("id", "company_id", "season", "batch", F.when(F.col("event") == "open", "开放").otherwise("黄金期").alias("event"), "month_start", "month_end", "verify_status", "valid_until",
                           F.concat(F.col("month_start").cast("string"), F.lit("月")).alias("value_text"), F.expr("case id % 4 when 0 then '精确日期' when 1 then '日期范围' else '月' end").alias("time_expr_type"))


USABLE = "(select * from (select *, max(case when season = '秋招' then 1 else 0 end) over (partition by company_id) as has from (select * from r_claims where verify_status = 'verified' and valid_until >= date '1999-08-02')) where has = 0 or season = '秋招')"


@query("precise_dates", f"select company_id, batch, cast(month_start as varchar) || '月' as value_text from (select *, row_number() over (partition by company_id, batch order by id) rn from {USABLE} where id % 4 in (0, 1)) where rn = 1")
def _(t):
    return CA.precise_dates(obs(t), "1999-08-02 00:00:00")


@query("batch_gap", f"select company_id, cast(floor((m - e) * 4.3 + 0.5) as int) as weeks from (select company_id, arg_min(month_start, id) filter (batch = '提前批') as e, arg_min(month_start, id) filter (batch = '正式批') as m from {USABLE} where event = 'open' group by 1) where floor((m - e) * 4.3 + 0.5) > 0")
def _(t):
    return CA.batch_gap(obs(t), "1999-08-02 00:00:00")


@query("campus_timeline", f"""with o as (select * from (select *, row_number() over (partition by company_id, batch order by month_start, id) rn from {USABLE}) where rn = 1) select company_id, string_agg(batch || cast(month_start as varchar) || '月', ',' order by case batch when '提前批' then 1 when '正式批' then 2 else 3 end) as batches,
  case when bool_or(8 between month_start and month_end) then arg_min(case when event = 'close' then '现处黄金期' else '现处' || batch end, case batch when '提前批' then 1 when '正式批' then 2 else 3 end) filter (8 between month_start and month_end) when 8 > max(month_end) and 8 - max(month_end) <= 3 then '往年这时多已近尾声' end as phase from o group by company_id""")
def _(t):
    return CA.campus_timeline(obs(t), "1999-08-02 00:00:00")


@query("overlapping_claims", """with d as (select distinct company_id, season, batch, event, month_start, month_end, publisher from r_claims), c as (select min(id) as id, company_id, season, batch, event, publisher, month_start, month_end from r_claims group by all)
  select company_id, count(*) as pairs from c a join c b using (company_id, season, batch, event) where greatest(a.month_start, b.month_start) <= least(a.month_end, b.month_end) and a.id <> b.id group by company_id""")
def _(t):
    c = t.claims.groupBy("company_id", "season", "batch", "event", "publisher", "month_start", "month_end").agg(F.min("id").alias("id"))
    return C.overlapping(c, ["company_id", "season", "batch", "event"], "month_start", "month_end", "id").groupBy("company_id").agg(F.count("*").alias("pairs"))


@query("cycle_consensus", """with r as (select distinct company_id, season, batch, event, month_start, month_end from r_claims), n as (select r.company_id, r.season, r.batch, r.event, r.month_start, r.month_end, count(distinct c.publisher) as n_pub from r join r_claims c on r.company_id = c.company_id and r.season = c.season and r.batch = c.batch and r.event = c.event and greatest(r.month_start, c.month_start) <= least(r.month_end, c.month_end) group by all)
  select company_id, season, batch, event, month_start, month_end, n_pub, case when n_pub >= 2 then 'verified' else 'draft' end as status from (select *, row_number() over (partition by company_id, season, batch, event order by n_pub desc, month_end - month_start, month_start) rn from n) where rn = 1""")
def _(t):
    return CA.cycle_consensus(t.claims)


@query("duplicate_boards", """with e as (select distinct source_id % 7 as tenant, l_partkey % 997 as i from r_posts where l_linenumber in (1, 2)), c as (select distinct source_id % 7 as tenant, source_id as board, l_partkey % 997 as i from r_posts where l_linenumber = 3) select c.tenant, c.board, count(*) as total, count(e.i) as shared, count(e.i) >= count(*) * 0.8 as duplicate from c left join e on e.tenant = c.tenant and e.i = c.i group by all""")
def _(t):
    p = t.posts.withColumn("tenant", F.col("source_id") % 7)
    return CA.duplicate_boards(p.where("l_linenumber in (1, 2)"), p.where("l_linenumber = 3").withColumn("board", F.col("source_id")))


@query("campus_candidates", "select id from r_sources where enabled and adapter_name in ('moka', 'hotjob') and id % 9 <> 0")
def _(t):
    led = t.sources.where("id % 9 = 0").select(U.campus_url("adapter_name", "source_url").alias("candidate"), F.lit("2002-01-01").cast("timestamp").alias("next_retry_at")).where("candidate is not null")
    return CA.campus_candidates(t.sources, led, NOW).select("id")


@query("retry_rules", "select event_id, month(ts) in (2, 3, 4, 8, 9, 10, 11) as season, case cast(floor(value) as int) % 3 when 0 then 14 when 1 then 3650 else 30 end as wait, ts <= timestamp '2024-01-15 00:00:00' - interval 50 minute or ts > timestamp '2024-01-15 00:00:00' as due from events")
def _(t):
    e = t.base("events").withColumn("state", F.expr("case cast(floor(value) as int) % 3 when 0 then 'empty_board' when 1 then 'robots_blocked' else 'other' end")).withColumn("m", F.month("ts"))
    return e.select("event_id", CA.is_campus_season("m").alias("season"), CA.retry_days("state", "m").alias("wait"), CA.is_due("ts", "2024-01-15 00:00:00").alias("due"))


@query("undercrawled", "select id, case when reported_total > 0 then jobs_found / reported_total end as ratio, case when reported_total > 0 then jobs_found / reported_total < 0.9 end as under from r_runs")
def _(t):
    return t.runs.select("id", CA.coverage_ratio("jobs_found", "reported_total").alias("ratio"), CA.undercrawled("jobs_found", "reported_total").alias("under"))


@query("classify_board", "select id, case when status = 'failed' then 'no_healthy_jobs' when status = 'skipped' then 'no_healthy_jobs' else 'empty_board' end as state from r_runs")
def _(t):
    r = t.runs.select("id", F.expr("case when status = 'failed' then 1 end").alias("failed"), F.expr("case when status = 'success' then 1 end").alias("success"), F.expr("case when status = 'partial_success' then 1 end").alias("empty"))
    return CA.classify_board(r).select("id", "state")


@query("board_decisions", """select id, case when id % 10 = 3 then 'duplicate_board' when id % 7 = 1 then 'robots_blocked' when id % 7 = 2 then 'unreachable' when status in ('failed', 'skipped') then 'no_healthy_jobs' else 'empty_board' end as state,
  timestamp '2001-09-02 00:00:00' + to_days(case when id % 10 = 3 then 3650 when id % 7 = 1 then 3650 when id % 7 = 2 then 30 when status in ('failed', 'skipped') then 30 else 3 end) as next_retry_at from r_runs""")
def _(t):
    r = t.runs.select("id", F.concat(F.lit("b"), F.col("id")).alias("candidate"), F.expr("case when status = 'failed' then 1 end").alias("failed"), F.expr("case when status = 'success' then 1 end").alias("success"),
                      F.expr("case when status = 'partial_success' then 1 end").alias("empty"), F.expr("case id % 7 when 1 then 'robots_blocked' when 2 then 'unreachable' end").alias("reason"))
    boards = r.select("id", "candidate", F.expr("case when id % 10 = 3 then id + 1 end").alias("duplicate_of"))
    return CA.board_decisions(r, boards.union(boards.where("id % 10 = 3")), "2001-09-02 00:00:00").select("id", "state", "next_retry_at")


# --- queues ---

@query("enrich_queue", "select id, row_number() over (partition by source_id order by first_seen_at desc, id) as turn from r_posts where status = 'active' and l_linenumber % 3 = 0 and enrich_fail_count < 3 and source_id in (select id from r_sources where enabled)")
def _(t):
    j = t.posts.withColumn("summary", F.expr("case when l_linenumber % 3 = 0 then null else 'x' end"))
    return QU.enrich_queue(j, t.sources.where("enabled")).select("id", "turn")


@query("liveness_queue", "select id, turn, case when company like '%00' then 0 else 1 end as turn_priority from (select *, row_number() over (partition by source_id order by enrich_checked_at asc nulls first, id) as turn from r_posts where status = 'active')")
def _(t):
    q = QU.interleaved(QU.liveness_queue(t.posts, t.sources), t.sources.where("company like '%00'"))
    return q.select("id", "turn", "turn_priority")


@query("fair_queue", "select id from (select *, row_number() over (partition by source_id order by enrich_checked_at asc nulls first, id) rn from r_posts where status = 'active') where rn <= 5 order by enrich_checked_at asc nulls first, id limit 450")
def _(t):
    return QU.fair_queue(t.posts, 90, 450).select("id")


@query("audit_queue", "with m as (select id, last_seen_at from r_posts where status = 'active' and source_id % 10 = 0 order by last_seen_at, id limit 50), r as (select id, last_seen_at, 0 as p from m union all select id, last_seen_at, 1 from r_posts where status = 'active' and id not in (select id from m)) select id from r order by p, last_seen_at, id limit 100")
def _(t):
    a = t.posts.where("status = 'active'").select("id", "source_id", "last_seen_at")
    return QU.audit_queue(a.where("source_id % 10 = 0"), a, [F.col("last_seen_at"), F.col("id")], 100).select("id")


@query("new_first_queue", "select id from r_posts where status = 'active' and enrich_checked_at is null and first_seen_at >= timestamp '2001-07-20' order by first_seen_at desc, id limit 40")
def _(t):
    return QU.new_first_queue(t.posts, "2001-07-22 00:00:00", 40).select("id")


@query("gap_queue", "select company from (select s_name as company, n_name as ind, s_suppkey from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 = 0 or s_suppkey % 4 = 0) order by case when ind in ('NATION_1', 'NATION_2', 'NATION_15') then 0 else 1 end, case when s_suppkey % 5 = 0 then 0 else 1 end, (s_suppkey % 7) / 7, lower(company) limit 20")
def _(t):
    r = t.sources.select("company", F.array("industry").alias("industries"), (F.col("id") % 5 == 0).alias("wanted"), ((F.col("id") % 7) / 7).alias("coverage"),
                         F.expr("case when id % 3 = 0 then null else 'thin_only' end").alias("state"), F.expr("case when id % 4 = 0 then timestamp '2001-01-01' end").alias("next_retry_at"))
    return QU.gap_queue(r, ["NATION_1", "NATION_2", "NATION_15"], NOW).select("company")


@query("plan_targets")
def _(t):
    c = t.supplier.select(F.col("s_name").alias("company"), (F.col("s_suppkey") % 3).alias("tier"))
    return QU.plan_targets(c, t.supplier.where("s_suppkey % 4 = 0").select(F.col("s_name").alias("company")), 40, 7)


@query("insight_queue", "select s_suppkey as id from supplier where s_suppkey % 3 = 0 or s_suppkey % 3 = 1")
def _(t):
    p = t.supplier.select(F.col("s_suppkey").alias("id"), F.expr("case s_suppkey % 3 when 0 then null when 1 then timestamp '2001-01-01' else timestamp '2001-08-01' end").alias("t3_enriched_at"), (F.col("s_suppkey") % 50 + 1950).alias("founded_year"))
    return QU.insight_queue(p, NOW, "t3").select("id")


@query("throttle", f"""with r as (select user_id, case event_type when 'view' then 'queued' when 'click' then 'running' else 'done' end as st, epoch({EN}) - epoch(ts) as age from events), g as (select user_id, bool_or(st in ('queued', 'running') and age < 30000 * 60) as live, min(age) as age from r group by 1)
  select user_id, case when live then 'reuse' when age < 20000 * 60 then 'cooldown' else 'dispatch' end as action from g""")
def _(t):
    r = t.base("events").select("user_id", F.col("event_id").alias("id"), F.date_trunc("second", "ts").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"),
                                F.expr("case event_type when 'view' then 'queued' when 'click' then 'running' else 'done' end").alias("status"))
    return QU.throttle(r, EVENTS_NOW, 20000, 30000).select("user_id", "action")


@query("insight_throttle", f"with g as (select user_id % 30 as company_key, bool_or(event_type in ('view') and epoch({EN}) - epoch(ts) < 6 * 3600) as live, max(ts) as last from events group by 1) select company_key, case when live then 'reuse' when last + interval 6 hour > {EN} then 'cooldown' when (select count(*) from events where ts >= {EN} - interval 1 hour) >= 5 then 'global_cap' else 'dispatch' end as action from g")
def _(t):
    r = t.base("events").select((F.col("user_id") % 30).alias("company_key"), F.col("ts").alias("created_at"), F.expr("case when event_type = 'view' then 'queued' else 'done' end").alias("status"))
    return QU.insight_throttle(r, EVENTS_NOW)


@query("cache_hits", """select request_id, run_id from (select a.event_id as request_id, b.event_id as run_id, row_number() over (partition by a.event_id order by b.ts desc, b.event_id desc) rn from events a join events b on a.user_id = b.user_id and (case when a.event_type = 'view' then null else a.event_type end) is not distinct from (case when b.event_type = 'view' then null else b.event_type end)
  and b.ts <= a.ts - interval 1 second and b.ts >= a.ts - interval 1 second - interval 1440 minute) where rn = 1""")
def _(t):
    e = t.base("events").withColumn("mode", F.expr("case when event_type = 'view' then null else event_type end"))
    req = e.select("user_id", "mode", (F.col("ts") - F.expr("interval 1 second")).alias("asked_at"), F.col("event_id").alias("request_id"))
    return QU.cache_hits(req, e.select("user_id", "mode", F.col("ts").alias("created_at"), F.col("event_id").alias("run_id")), 1440).select("request_id", "run_id")


# --- audits and validation ---

@query("duplicate_audit", f"""with a as (select company, title, jd_url, {canon('jd_url')} as cu from r_posts where status = 'active'), g as (select 'jd_url' as key, count(*) as n, count(distinct company) as c, count(distinct title) as tt from a group by jd_url having count(*) > 1 union all select 'canonical_jd_url', count(*), count(distinct company), count(distinct title) from a group by cu having count(*) > 1)
  select key, count(*) as groups, cast(sum(n - 1) as bigint) as surplus, count(*) filter (c > 1) as name_conflicts, count(*) filter (tt > 1) as title_conflicts from g group by key""")
def _(t):
    return A.duplicate_audit(t.posts)


@query("completeness", f"""select count(*) as total, count(*) filter (coalesce(location, '') = '') as location_missing, count(*) filter (coalesce(job_type, '') = '') as job_type_missing, count(*) filter (coalesce(salary_text, '') = '') as salary_text_missing, count(*) filter (coalesce(education, '') = '') as education_missing, count(*) filter (coalesce(deadline, '') = '') as deadline_missing,
  count(*) filter (last_seen_at < {N} - interval 7 day) as stale_7d, count(*) filter (last_seen_at < {N} - interval 14 day) as stale_14d, count(*) filter (last_seen_at < {N} - interval 30 day) as stale_30d from r_posts where status = 'active'""")
def _(t):
    return A.completeness(t.posts, NOW)


VERD = f"case when {S.contains_any('lower(html)', A.DEAD_MARKERS)} then 'dead' when contains(lower(html), lower(substr(regexp_extract(html, '<title>(.*?)</title>', 1), 1, 8))) then 'alive' else 'suspect' end"


@query("page_verdict", f"select page_id, {VERD} as verdict, (regexp_matches(lower(html), 'captcha') or (contains(lower(html), 'verify') and contains(lower(html), 'human')) or (contains(lower(html), 'login') and contains(lower(html), '<form') and contains(lower(html), 'password'))) as blocked from pages")
def _(t):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return t.pages.select("page_id", A.page_verdict("html", title).alias("verdict"), A.blocked_page("html", F.lit(200)).alias("blocked"))


@query("verdict_by_host", f"select lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host, count(*) filter (v = 'alive') as alive, count(*) filter (v = 'dead') as dead, count(*) filter (v = 'suspect') as suspect, count(*) filter (v = 'unsure') as unsure from (select url, {VERD} as v from pages) group by 1")
def _(t):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return A.verdict_by_host(t.pages.select("url", A.page_verdict("html", title).alias("verdict")))


@query("source_verification", "select adapter_name, count(*) filter (status = 'success') as success, count(*) filter (status = 'partial_success') as partial_success, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'skipped') as skipped, count(*) filter (r.id % 3 = 0) as host_mismatch from r_runs r join r_sources s on s.id = r.source_id group by 1")
def _(t):
    r = t.runs.join(t.sources.select(F.col("id").alias("source_id"), "adapter_name"), "source_id")
    return A.source_verification(r.select("adapter_name", "status", F.lit("a").alias("source_host"), F.expr("case when id % 3 = 0 then 'b' else 'a' end").alias("job_host")))


@query("filter_funnel", "with c as (select c_custkey as combo_id, case c_custkey % 3 when 0 then '北京' when 1 then 'shanghai' else 'remote' end as city, case c_custkey % 2 when 0 then '社招' else '实习' end as jt from customer) select combo_id, count(*) as in_city, count(*) filter (j.job_type = c.jt) as of_type from c join r_posts j on j.status = 'active' and contains(lower(coalesce(j.location, '')), c.city) where combo_id < 1000000000 group by combo_id")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("combo_id"), F.expr("case c_custkey % 3 when 0 then '北京' when 1 then 'shanghai' else 'remote' end").alias("city"), F.expr("case c_custkey % 2 when 0 then '社招' else '实习' end").alias("job_type"))
    return A.filter_funnel(t.posts, c)


@query("facets", f"select distinct 'city' as facet, {CITYHEAD} as value from r_posts where {CITYHEAD} is not null union select 'function', {COARSE} from r_posts union select 'education', '本科' from r_posts where education = '本科及以上，硕士优先' and false union select distinct 'education', case when contains(education, '硕士') then '硕士' when education = '学历不限' then '不限' end from r_posts where coalesce(education, '') <> ''")
def _(t):
    return A.facets(t.posts)


@query("source_acceptance", "with a as (select *, row_number() over (partition by source_id order by first_seen_at desc, id) rn from r_posts where status = 'active') select source_id, count(*) as total, count(*) filter (jd_url <> '' and title <> '') as healthy, string_agg(id, ',' order by rn) filter (rn <= 5) as samples from a group by source_id")
def _(t):
    return A.source_acceptance(t.posts)


@query("page_fields", "select page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), '&quot;', '\"'), '\\s+', ' ', 'g')) as title, regexp_matches(html, '\\d{4}[-/.年]\\d{1,2}[-/.月]\\d{1,2}') as has_date from pages")
def _(t):
    p = A.page_fields("html")
    return t.pages.select("page_id", p["title"].alias("title"), p["has_date"].alias("has_date"))


PIISQL = " or ".join(f"regexp_matches(c, {S.q(p.replace('(?<![A-Za-z0-9_])', chr(92) + 'b').replace('(?![A-Za-z0-9_])', chr(92) + 'b'))})" for p in VA.PII)


@query("validate_submissions", f"select id, case when rating is not null and rating not between 1 and 5 then 'invalid_rating' when c = '' then 'content_required' when {PIISQL} then 'pii_detected' when lang = 'de' then 'consent_required' end as reason from (select id, rating, lang, trim(regexp_replace(content, '\\s+', ' ', 'g')) as c from r_subs)")
def _(t):
    return VA.validate_submissions(t.subs.withColumn("consent", F.col("lang") != "de"), None).select("id", "reason")


@query("pii_conversations", f"select conv_id, turn, ({PIISQL}) as pii from (select conv_id, turn, text as c from conversations)")
def _(t):
    return t.conversations.select("conv_id", "turn", VA.contains_pii("text").alias("pii"))


@query("validate_cycle_claims", "select id, case when batch = '补录' and id % 9 = 2 then 'missing_evidence' when abs(date_diff('day', date '1998-01-01', date_start)) > 1095 then 'date_out_of_window' end as reason from r_claims")
def _(t):
    c = t.claims.withColumn("publisher", F.expr("case when batch = '补录' and id % 9 = 2 then '' else publisher end"))
    return VA.validate_cycle_claims(c, "1998-01-01 00:00:00").select("id", "reason")


@query("clean_events", """select id, upper(event) as event, payload->>'$.result' as result, payload->>'$.result' as inner_result, cast(null as varchar) as adapter, cast(null as varchar) as inner_adapter from r_tracks""")
def _(t):
    wrapped = F.concat(F.lit('{"AD APTER":"x","Adapter ":{"a":1},"list":[{"inner":'), "payload", F.lit("}],"), F.expr("substr(payload, 2)"))
    e = VA.clean_events(t.tracks.withColumn("event", F.concat(F.lit(" "), F.upper("event"))).withColumn("payload", wrapped), forbidden=["adapter", "ad_apter"])
    j = lambda path: F.get_json_object("payload", path)
    return e.select("id", "event", j("$.result").alias("result"), j("$.list[0].inner.result").alias("inner_result"), j("$.adapter").alias("adapter"), j("$.list[0].inner.adapter").alias("inner_adapter"))


@query("daily_event_windows", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by all")
def _(t):
    w = t.base("events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("user_sessions", "with s as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 600 minute then 0 else 1 end as new from events), g as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from s) select user_id, n, count(*) as sessions from (select user_id, sid, count(*) as n from g group by all) group by user_id, n")
def _(t):
    w = t.base("events").groupBy(F.session_window("ts", "600 minutes"), "user_id").agg(F.count("*").alias("n"))
    return w.groupBy("user_id", "n").agg(F.count("*").alias("sessions"))
