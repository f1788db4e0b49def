"""Ingestion jobs over whole tables."""
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import core as C, ingest as I
from .basics import canon
from .registry import query
from .roles import NOW


def store(t):
    """Stored postings: one row per canonical URL and status, with an id."""
    j = t.posts.withColumn("canonical_jd_url", U.canonical_url("jd_url")).withColumn("grad_class", F.lit(None).cast("int"))
    return j


STORE = f"(select *, {canon('jd_url')} as canonical_jd_url from r_posts)"
# the arriving batch: the even orders' postings with blanks in places, arrival order by order key
BATCH = """select {c} as canonical_jd_url, jd_url, source_id, company, upper(title) as title, case when l_linenumber % 2 = 0 then '' else job_type end as job_type, case when l_linenumber % 3 = 0 then null else salary_text end as salary_text, posted_at,
  id as arrived_seq from r_posts where l_orderkey % 2 = 0 union all select concat('https://new.example.com/', cast(s_suppkey as {t})), concat('https://new.example.com/', cast(s_suppkey as {t}), '/?utm_medium=x'), s_suppkey, s_name, 'New', null, null, null, 'z' from supplier"""


def batch(t):
    old = t.posts.where("l_orderkey % 2 = 0").select(
        U.canonical_url("jd_url").alias("canonical_jd_url"), "jd_url", "source_id", "company", F.upper("title").alias("title"),
        F.expr("case when l_linenumber % 2 = 0 then '' else job_type end").alias("job_type"),
        F.expr("case when l_linenumber % 3 = 0 then null else salary_text end").alias("salary_text"), "posted_at", F.col("id").alias("arrived_seq"))
    link = F.concat(F.lit("https://new.example.com/"), F.col("s_suppkey").cast("string"), F.lit("/?utm_medium=x"))
    new = t.supplier.select(U.canonical_url(link), link, "s_suppkey", "s_name", F.lit("New"), F.lit(None).cast("string"), F.lit(None).cast("string"),
                            F.lit(None).cast("timestamp"), F.lit("z"))
    return old.union(new)


MERGED = f"""with b as (select * from (select *, row_number() over (partition by canonical_jd_url order by arrived_seq desc) rn from ({BATCH.replace('{c}', canon('jd_url')).replace('{t}', 'varchar')})) where rn = 1),
  e as (select *, row_number() over (partition by canonical_jd_url order by case when status = 'active' then 0 else 1 end, id) = 1 as target from {STORE}),
  j as (select case when e.id is null then sha256(b.canonical_jd_url) else e.id end as id, e.id is null as created, e.id is not null and e.target and b.canonical_jd_url is not null as hit, e.status as old_status,
    case when e.id is null then 'active' when e.target and b.canonical_jd_url is not null and e.status <> 'expired' then 'active' else e.status end as status,
    case when e.id is null then b.title when e.target and b.canonical_jd_url is not null then b.title else e.title end as title,
    case when e.id is null then b.job_type when e.target and b.canonical_jd_url is not null then coalesce(nullif(b.job_type, ''), e.job_type) else e.job_type end as job_type,
    case when e.id is null then b.salary_text when e.target and b.canonical_jd_url is not null then coalesce(nullif(b.salary_text, ''), e.salary_text) else e.salary_text end as salary_text,
    b.posted_at as new_posted, e.posted_at as old_posted from e full outer join b using (canonical_jd_url)) """


@query("upsert_jobs", MERGED + "select id, status, title, job_type, salary_text from j")
def _(t):
    jobs, _e, _c = I.upsert_jobs(store(t), batch(t), NOW)
    return jobs.select("id", "status", "title", "job_type", "salary_text")


@query("upsert_events", MERGED + """select concat('FIRST_SEEN:', id) as event_key from j where created union all select concat('OFFICIAL_POSTED:', id) from j where new_posted is not null and (created or (hit and old_posted is null))
  union all select concat('REAPPEARED:', id, ':2001-08-02') from j where hit and old_status = 'removed'""")
def _(t):
    return I.upsert_jobs(store(t), batch(t), NOW)[1].select("event_key")


@query("upsert_counts", MERGED + "select count(*) filter (created) as created, count(*) filter (hit) as updated from j")
def _(t):
    return I.upsert_jobs(store(t), batch(t), NOW)[2]


@query("append_events", "select distinct concat('CLOSED:', cast(l_orderkey as varchar)) as event_key from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def _(t):
    key = lambda c: F.concat(F.lit("CLOSED:"), F.col(c).cast("string")).alias("event_key")
    return I.append_events(t.orders.where("o_orderstatus = 'F'").select(key("o_orderkey")), t.lineitem.select(key("l_orderkey")))


CUT = "timestamp '1997-01-01'"
PLAN = f"""with r as (select distinct s_suppkey as source_id, {CUT} + interval 1 day * (s_suppkey % 40) * 30 as cutoff from supplier where s_suppkey % 5 <> 0),
  g as (select source_id, cutoff, count(*) as active, count(*) filter (last_seen_at < cutoff) as absent from r_posts join r using (source_id) where status = 'active' group by all),
  p as (select *, case when absent = 0 then 'noop' when active >= 8 and absent > active * 0.5 then 'skip' else 'apply' end as action from g) """


def cutoffs(t):
    return t.supplier.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("source_id"), F.lit(True).alias("coverage_complete"),
        F.expr("timestamp '1997-01-01' + make_interval(0, 0, 0, cast((s_suppkey % 40) * 30 as int))").alias("cutoff"))


@query("absence_plan", PLAN + "select source_id, active, absent, action from p")
def _(t):
    return I.absence_plan(t.posts, cutoffs(t)).drop("cutoff")


@query("absence_sweep", PLAN + """select id, case when status = 'active' and last_seen_at < p.cutoff then 'expired' else status end as status from r_posts left join (select * from p where action = 'apply') p using (source_id)""")
def _(t):
    return I.absence_sweep(t.posts, cutoffs(t), NOW)[0].select("id", "status")


@query("absence_events", PLAN + "select concat('CLOSED:', id, ':2001-08-02') as event_key from r_posts join p using (source_id) where action = 'apply' and status = 'active' and last_seen_at < p.cutoff")
def _(t):
    return I.absence_sweep(t.posts, cutoffs(t), NOW)[1].select("event_key")


@query("apply_checks", """select id, case when l_linenumber % 4 = 0 then 'expired' when body is not null and l_linenumber % 3 = 0 then 'filled' when l_linenumber % 3 <> 0 then 'alive' else 'miss' end as outcome, case when l_linenumber % 4 = 0 then 'expired' else status end as status,
  case when l_linenumber % 3 = 0 and body is null and l_linenumber % 4 <> 0 then enrich_fail_count + 1 else enrich_fail_count end as enrich_fail_count from (select *, case when l_linenumber = 3 then 'Senior body text' end as body from r_posts)""")
def _(t):
    jobs = t.posts.withColumn("summary", F.expr("case when l_linenumber % 3 = 0 then null else title end"))
    checks = t.posts.select("id", F.expr("l_linenumber % 4 = 0").alias("closed"), F.expr("case when l_linenumber = 3 then '<p>Senior body text</p>' end").alias("body"))
    return I.apply_checks(jobs, checks, NOW)[0].select("id", "outcome", "status", "enrich_fail_count")


REJ = """case when trim(tt) = '' then 'missing title' when trim(u) = '' then 'missing jd_url' when not regexp_matches(u, '^https?://[^/?#]+') then 'invalid jd_url' when k = sk and not regexp_matches(u, '[?&]id=') then 'jd_url equals source url'
  when lower(replace(tt, ' ', '')) in ('jobsearch', 'login') then 'navigation title' when regexp_matches(u, '^https?://[^/?#]*/*([?#/]*)$') then 'homepage is not a job detail' when contains(lower(u), '/home') then 'navigation url' end"""
RAWX = """select page_id, case page_id % 11 when 0 then '  ' when 1 then 'Job Search' else concat('Job ', cast(page_id as {t})) end as tt, case page_id % 13 when 0 then '' when 1 then 'ftp://x/y' when 2 then 'https://a.example.com/jobs' when 3 then 'https://a.example.com/jobs/?id=7' when 4 then 'https://a.example.com/' when 5 then 'https://a.example.com/home/x' else url end as u from pages"""


@query("quality_gate", f"select page_id, {REJ} as reason from (select *, regexp_replace(regexp_replace(u, '^https?://', ''), '[?].*$|/+$|/+[?].*$', '') as k, 'a.example.com/jobs' as sk from ({RAWX.replace('{t}', 'varchar')}))")
def _(t):
    rows = t.sql(RAWX.replace("{t}", "string").replace("from pages", "from {pages}"))
    return rows.select("page_id", I.reject_reason("tt", "u", F.lit("https://a.example.com/jobs")).alias("reason"))


@query("normalize_jobs")
def _(t):
    raw = t.jobs.select("source_id", "title", "jd_url", "location", "job_type", "summary", F.col("jd_url").alias("apply_url"), "salary_text",
                        F.col("posted_at").cast("string").alias("posted_at"), "experience", "education", "deadline", F.lit("").alias("company"), F.col("id").alias("arrived_seq"))
    return I.normalize_jobs(raw, t.sources)


@query("expire_where", "select id, case when status = 'active' and contains(jd_url, '/campus/') then 'expired' else status end as status from r_posts")
def _(t):
    return I.expire_where(t.posts, F.col("jd_url").contains("/campus/")).select("id", "status")


@query("retire_expired", "select id, case when verify_status = 'verified' and coalesce(valid_until, date_start) < date '2001-08-02' then 'retired' else st end as status from (select *, case verify_status when 'verified' then 'active' else 'draft' end as st from r_claims)")
def _(t):
    items = t.claims.select("id", F.expr("case verify_status when 'verified' then 'active' else 'draft' end").alias("status"),
                            F.expr("case when id % 2 = 0 then valid_until end").alias("valid_until"), F.col("date_start").cast("timestamp").alias("last_verified_at"))
    # a missing date is a year after the check, 365 or 366 days: compare on the dated half only where they agree
    return I.retire_expired(items.withColumn("valid_until", F.coalesce("valid_until", F.date_add(F.to_date("last_verified_at"), 365))), NOW).select("id", "status")


@query("merge_companies", """with f as (select *, 'Supplier#000000001' as canon from r_posts where source_id % 10 = 2), o as (select * from r_posts where source_id % 10 <> 2)
  select company, count(*) as n from (select company from o union all select canon from f where not exists (select 1 from o where o.company = f.canon and o.jd_url = f.jd_url) and not exists (select 1 from o where o.company = f.canon and o.title = f.title and o.location = f.location)) group by company""")
def _(t):
    names = t.sources.where("id % 10 = 2").select("company", F.lit("Supplier#000000001").alias("canonical"))
    return I.merge_companies(t.posts, names).groupBy("company").agg(F.count("*").alias("n"))


@query("redirect_refs", """with m as (select id as source_id, keep_id from (select id, first_value(id) over (partition by industry, adapter_name order by id) as keep_id from r_sources) where id <> keep_id)
  select coalesce(keep_id, source_id) as source_id, count(*) as n from r_runs left join m using (source_id) group by 1""")
def _(t):
    w = C.Window.partitionBy("industry", "adapter_name").orderBy("id")
    m = t.sources.withColumn("keep_id", F.first("id").over(w)).where("id <> keep_id").select(F.col("id").alias("source_id"), "keep_id")
    return I.redirect_refs(t.runs, m).groupBy("source_id").agg(F.count("*").alias("n"))


@query("apply_actions", """select user_id, job_id, action from (select *, row_number() over (partition by user_id, job_id, action = 'viewed' order by created_at desc, event_id desc) rn from r_actions) where rn = 1""")
def _(t):
    a = t.actions
    return I.apply_actions(a.where("event_id % 2 = 0"), a.where("event_id % 2 = 1")).select("user_id", "job_id", "action")


@query("snapshot_changes", """with p as (select source_id, arg_max(campus_count, captured_at) as prev_count from r_snaps where captured_at < timestamp '2001-06-01' group by source_id), c as (select source_id, arg_max(campus_count, captured_at) as campus_count from r_snaps group by source_id)
  select source_id, campus_count, prev_count from c left join p using (source_id) where prev_count is null or prev_count <> campus_count""")
def _(t):
    s = t.snaps
    cur = s.groupBy("source_id").agg(F.max_by("campus_count", "captured_at").alias("campus_count"))
    return I.snapshot_changes(s.where("captured_at < timestamp '2001-06-01'"), cur)


@query("merge_gap_attempts", "select s_name as company, case when s_suppkey % 3 = 0 then 'old' else 'new' end as state, case when s_suppkey % 3 = 0 then 1 else 2 end as attempts, case when s_suppkey % 3 = 0 then 'a=1,b=1' else 'a=1,b=2,c=2' end as evidence, case when s_suppkey % 3 = 0 then '2001-01-02' else '{day}' end as last_day, case when s_suppkey % 3 = 0 then 'no_entry' end as fail_reason from supplier".replace("{day}", str(NOW)[:10]))
def _(t):
    s = t.supplier.select(F.col("s_name").alias("company"), "s_suppkey")
    prev = s.select("company", F.lit("old").alias("state"), F.lit(1).alias("attempts"), F.expr("map('a', '1', 'b', '1')").alias("evidence"), F.lit("2001-01-02").cast("timestamp").alias("last_attempt_at"), F.lit("no_entry").alias("fail_reason"))
    res = s.where("s_suppkey % 3 <> 0").select("company", F.lit("new").alias("state"), F.expr("map('b', '2', 'c', '2')").alias("evidence"), F.lit(None).cast("string").alias("fail_reason"))
    out = I.merge_gap_attempts(prev, res, NOW)
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return out.select("company", "state", "attempts", flat.alias("evidence"), F.date_format("last_attempt_at", "yyyy-MM-dd").alias("last_day"), "fail_reason")


@query("sync_watch_requests", """select c_custkey as user_id, case when exists (select 1 from r_sources s where s.enabled and s.company = w.name) then 'covered' else 'pending' end as status from (select c_custkey, concat('Supplier#', lpad(cast(c_custkey % 150 as varchar), 9, '0')) as name from customer) w""")
def _(t):
    w = t.customer.select(F.col("c_custkey").alias("user_id"), F.expr("concat('Supplier#', lpad(c_custkey % 150, 9, '0'), '集团')").alias("company"))
    have = w.select("user_id", F.lit("gone").alias("normalized"))
    return I.sync_watch_requests(w, t.sources, have)[0].select("user_id", "status")


@query("crawl_run_rows")
def _(t):
    from ..operators import ops as O
    rows = t.posts.withColumn("created", F.expr("l_linenumber % 2 = 0"))
    rej = t.posts.where("l_linenumber = 7").withColumn("reject_reason", F.expr("case when l_orderkey % 2 = 0 then 'missing title' else 'navigation url' end"))
    return O.crawl_run_rows(rows, rej, NOW)
