"""Search and feed over whole tables."""
from pyspark.sql import functions as F

from ..functions import fixed as V, geo as G, keywords as KW, scoring as SC, text as T, tokens as K
from ..functions.base import at
from ..operators import core as C, feed as FD, search as S
from ..sources.tables import checkpointed
from . import sqlgen as Q
from .basics import PAIRS, TOKENS
from .columns import CATEGORY, EXPLICIT, JOBFN
from .registry import query
from .roles import EVENTS_NOW, NOW

N = f"timestamp '{NOW}'"
HAY = "lower(concat_ws(' ', title, company, nullif(coalesce(location, ''), ''), nullif(coalesce(job_type, ''), ''), nullif(coalesce(summary, ''), ''), nullif(coalesce(salary_text, ''), '')))"


@query("scope_filter", """select id from r_posts where job_scope = 'overseas' and (country_code in ('US', 'SG') or (country_code is null and lower(coalesce(location, '')) like '%remote%'))""")
def _(t):
    return t.posts.where(G.in_scope("job_scope", "country_code", "location", "overseas", [])).select("id")


@query("scope_counts", """select count(*) filter (coalesce(job_scope, 'domestic') = 'domestic') as domestic, count(*) as every, count(*) filter (job_scope = 'overseas' and country_code = 'US') as us, count(*) filter (job_scope = 'overseas' and country_code is null and lower(location) like '%remote%') as remote from r_posts""")
def _(t):
    a = ("job_scope", "country_code", "location")
    return t.posts.agg(F.count_if(G.in_scope(*a, "domestic")).alias("domestic"), F.count_if(G.in_scope(*a, "all")).alias("every"),
                       F.count_if(G.matches_region(*a, "usa")).alias("us"), F.count_if(G.in_scope(*a, "domestic", None, "global")).alias("remote"))


@query("recruitment_prefilter", f"""select id from r_jobs where (regexp_matches(coalesce(job_type, ''), {Q.q('(?i)' + V.CAMPUS_PREFILTER_TYPE)}) or regexp_matches(jd_url, 'xiaozhao|campus') or regexp_matches(concat(title, ' ', coalesce(summary, '')), {Q.q('(?i)' + V.CAMPUS_PREFILTER_TEXT)}))
  and (job_type is null or not regexp_matches(job_type, {Q.q('(?i)' + V.DECLARED_SOCIAL)}))""")
def _(t):
    return t.jobs.where(S.recruitment_prefilter("校招")).select("id")


@query("stage_prefilter", "select id from r_posts where regexp_matches(lower(title), '实习|intern') or regexp_matches(lower(coalesce(job_type, '')), '实习|intern') or regexp_matches(lower(jd_url), 'shixi|intern')")
def _(t):
    return t.posts.where(S.stage_prefilter("实习")).select("id")


@query("exclude_terms", f"select id from r_jobs where not (contains({HAY}, 'widget') or contains({HAY}, 'nation') or contains({HAY}, '10-'))")
def _(t):
    return t.jobs.where(~S.excluded(F.array(F.lit(" Widget"), F.lit("nation"), F.lit("10-"), F.lit("")))).select("id")


@query("soft_city", "select id from r_posts where coalesce(location, '') = '' or contains(lower(location), '北京') or contains(lower(location), 'beijing') or contains(lower(location), '上海') or contains(lower(location), 'shanghai')")
def _(t):
    return t.posts.where(S.soft_city(["北京市", "shanghai"])).select("id")


@query("ilike_any", "select id, (company ilike '%12' or title ilike 'senior%ring') as pattern, (contains(lower(company), '12') or contains(lower(company), 'er#0')) as folded from r_posts")
def _(t):
    return t.posts.select("id", (F.col("company").ilike("%12") | F.col("title").ilike("senior%ring")).alias("pattern"), S.contains_any_folded("company", ["%12", "ER#0%"]).alias("folded"))


@query("freshness", f"""select id, case when h <= v then 'verified' when h <= a then 'aging' else 'stale' end as freshness, coalesce(ch <= 24, false) as today_ok, coalesce(ch <= 72, false) as search_ok from (select j.id, (epoch({N}) - epoch(last_seen_at)) / 3600 as h, (epoch({N}) - epoch(enrich_checked_at)) / 3600 as ch,
  case crawl_method when 'http' then 18 when 'playwright' then 36 else 72 end as v, case crawl_method when 'http' then 36 when 'playwright' then 72 else 144 end as a from r_posts j join r_sources s on s.id = j.source_id)""")
def _(t):
    j = t.posts.join(t.sources.select(F.col("id").alias("source_id"), "crawl_method"), "source_id")
    return j.select("id", SC.freshness_state("last_seen_at", "crawl_method", NOW).alias("freshness"), SC.verify_tier("enrich_checked_at", "today", NOW)["ok"].alias("today_ok"),
                    SC.verify_tier("enrich_checked_at", "search", NOW)["ok"].alias("search_ok"))


@query("recall_by_prefs", "select id from r_posts where status = 'active' and (contains(lower(location), '北京') or contains(lower(location), 'remote')) and contains(lower(title), 'engineer') order by first_seen_at desc, id limit 200")
def _(t):
    return S.recall_by_prefs(t.posts, ["北京", "Remote"], ["Engineer"], 200).select("id")


@query("by_keys", "select id from r_posts where status = 'active' and l_partkey in (select p_partkey from part where p_brand = 'Brand#2')")
def _(t):
    return C.by_keys(t.posts, t.part.where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", True).select("id")


@query("late_hydrate", "select id, jd_url, salary_text from r_posts where id in (select id from r_posts where status = 'active' order by last_seen_at desc, id limit 100)")
def _(t):
    page = t.posts.where("status = 'active'").orderBy(F.col("last_seen_at").desc(), "id").limit(100).select("id")
    return S.late_hydrate(page, t.posts, ["jd_url", "salary_text"])


@query("add_adapter", "select adapter_name, count(*) as n from r_posts j left join r_sources s on s.id = j.source_id group by 1")
def _(t):
    return C.add_dimension(t.posts, t.sources, "source_id", "id", ["adapter_name"]).groupBy("adapter_name").agg(F.count("*").alias("n"))


@query("fold_actions", "select user_id, job_id, arg_max(action, (created_at, event_id)) filter (action <> 'viewed') as primary_action, bool_or(action = 'viewed') as viewed from r_actions group by all")
def _(t):
    return S.fold_actions(t.actions)


DOC = PAIRS.replace("WORDS", TOKENS.replace("{c}", "concat_ws(' ', title, company, coalesce(location, ''), coalesce(job_type, ''))"))
# queries of a customer: its market segment or a part word, and a city
CLAUSES = """select c_custkey as query_id, 0 as grp, case c_custkey % 4 when 0 then 'product manager' when 1 then '算法' when 2 then 'senior widget' else '招聘 专员' end as term from customer
  union all select c_custkey, 0, case c_custkey % 3 when 0 then 'ring' else 'intern' end from customer union all select c_custkey, 1, case c_custkey % 3 when 0 then '北京' when 1 then 'shanghai' else '深圳市' end from customer"""


@query("token_search", f"""with doc as (select id, {DOC} as d from r_posts), q as ({CLAUSES}), terms as (select distinct term from q), c as (select term, list_filter({PAIRS.replace('WORDS', TOKENS.replace('{c}', 'term'))}, lambda x: x <> '') as tk from terms),
  hit as (select c.term, doc.id from c join doc on list_has_all(doc.d, c.tk)), kind as (select query_id, list_sort(list(distinct concat(grp, ' ', term))) as k from q group by query_id), kinds as (select k, min(query_id) as some from kind group by k),
  met as (select distinct kinds.k, q.grp, hit.id from kinds join q on q.query_id = kinds.some join hit on hit.term = q.term), full_ as (select k, id from met group by k, id having count(*) = 2),
  n as (select k, count(*) as n, min(id) as first_id, max(id) as last_id from full_ group by k) select kind.query_id, n.n, n.first_id, n.last_id from kind join n on n.k = kind.k""")
def _(t):
    q = t.sql(CLAUSES.replace("from customer", "from {customer}")).select("query_id", "grp", K.query_tokens("term").alias("tokens")).distinct()
    return S.token_search(FD.with_search_doc(t.posts).select("id", "search_doc"), q,
                          measures=[F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")])


@query("match_filters_plain", f"""select id, case when loc = '' or not explicit or edu = 'degrade' then 'related' else 'exact' end as tier, concat_ws(',', case when loc = '' then 'city' end, case when not explicit then 'type' end, case when edu = 'degrade' then 'education' end) as degraded from (
  select *, coalesce(location, '') as loc, {EXPLICIT} as explicit, {CATEGORY} as cat, case when trim(coalesce(education, '')) = '' then 'degrade' when {Q.edu_floor('education')} is null then 'pass' when {Q.edu_floor('education')} > 4 then 'reject' else 'pass' end as edu from r_jobs)
  where (loc = '' or contains(lower(loc), '北京') or contains(lower(loc), 'beijing') or contains(lower(loc), '深圳') or contains(lower(loc), 'shenzhen')) and (case when explicit then cat = '社招' else true end) and edu <> 'reject' and coalesce(salary_text, '') <> '' and sponsorship_signal <> 'none'""")
def _(t):
    f = S.Filters(city="北京 深圳", job_type="社招", education="本科", salary_only=True, sponsorship_only=True)
    jobs = t.jobs.withColumn("experience", F.lit(None).cast("string"))
    return S.match_filters(jobs, f, NOW).select("id", "tier", F.concat_ws(",", "degraded").alias("degraded"))


# two queries of the fixed vocabulary spelled out: 后端 (back end) and 产品经理 (product)
GROUPS = V.KEYWORD_GROUPS


def group_hit(i: int, subject: str, skip=()) -> str:
    out = []
    for term in GROUPS[i][1]:
        if term in skip:
            continue
        if KW.is_short(term):
            out.append(f"regexp_matches({subject}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')")
        else:
            out.append(f"contains({subject}, '{term}')")
    return "(" + " or ".join(out) + ")"


BODY = "trim(regexp_replace(lower(concat_ws(' ', company, nullif(location, ''), nullif(job_type, ''), nullif(summary, ''), nullif(salary_text, ''))), '\\s+', ' ', 'g'))"
ALL = "trim(regexp_replace(lower(concat_ws(' ', title, company, nullif(location, ''), nullif(job_type, ''), nullif(summary, ''), nullif(salary_text, ''))), '\\s+', ' ', 'g'))"


def tier_sql(i: int) -> str:
    fn = GROUPS[i][0]
    sib = [k for k, g in enumerate(GROUPS) if g[0] == fn and k != i]
    return (f"case when {group_hit(i, 'tt')} or (fn = '{fn}' and {group_hit(i, 'bb', V.TITLE_ONLY_ANCHORS)}) then 'exact'"
            + f" when fn = '{fn}' and not ({' or '.join(group_hit(k, 'aa') for k in sib) or 'false'}) then 'related' end")


@query("keyword_tiers", f"select id, {tier_sql(5)} as backend, {tier_sql(10)} as operations from (select id, {JOBFN} as fn, {Q.fold('title')} as tt, {BODY} as bb, {ALL} as aa from r_jobs)")
def _(t):
    gs = KW.vocabulary()
    j = KW.with_posting_features(t.jobs, gs)
    backend, operations = KW.request_features(j.sparkSession, ["后端", "运营"], gs)
    return j.select("id", KW.keyword_tier(backend, "kw").alias("backend"), KW.keyword_tier(operations, "kw").alias("operations"))


def profiles_of(t):
    """Profiles from the preference role and a small resume side."""
    arr = lambda c: F.when(F.col(c) != "", F.array(F.col(c))).otherwise(F.array().cast("array<string>"))
    prefs = t.prefs.select("user_id", "job_scope", F.array().cast("array<string>").alias("target_regions"), arr("role").alias("target_roles"), arr("city").alias("target_locations"),
                           F.when(F.col("user_id") % 2 == 0, F.array(F.lit("数据分析"), F.lit("前端"))).otherwise(F.array().cast("array<string>")).alias("target_keywords"),
                           F.when(F.col("user_id") % 9 == 0, F.array(F.expr("concat('Supplier#', lpad(user_id % 100, 9, '0'))"))).otherwise(F.array().cast("array<string>")).alias("target_companies"),
                           arr("exclude").alias("exclude_keywords"), F.array().cast("array<string>").alias("target_industries"), F.col("stage").alias("experience_stage"), "daily_limit")
    cand = t.prefs.where("user_id % 2 = 1").select("user_id", F.array(F.lit("marketing")).alias("target_roles"), F.array(F.lit("上海")).alias("target_locations"),
        F.array(F.lit("Python"), F.lit("python "), F.lit("SQL")).alias("skills"), F.array(F.lit("互联网"), F.lit("金融")).alias("industries"), F.array(F.lit("本科")).alias("education"),
        F.lit("硕士研究生").alias("education_summary"), F.lit("社招").alias("experience_stage"), F.lit("mid").alias("seniority"), (F.col("user_id") % 5 == 0).alias("has_en_resume"),
        F.array(F.lit("Product Manager")).alias("en_target_roles"), F.array().cast("array<string>").alias("en_target_keywords"), F.array(F.lit("SQL")).alias("en_skills"))
    return FD.build_profiles(prefs, cand)


@query("build_profiles", """select user_id, job_scope as scope, case when job_scope = 'domestic' then '' else 'US,SG,Remote' end as regions,
  case when job_scope <> 'domestic' and user_id % 2 = 1 and user_id % 5 = 0 then 'Product Manager' when role <> '' then role when user_id % 2 = 1 then 'marketing' else '' end as roles,
  case when city <> '' then city when user_id % 2 = 1 then '上海' else '' end as cities, case when user_id % 2 = 1 then case when job_scope <> 'domestic' and user_id % 5 = 0 then 'SQL' else 'Python,SQL' end else '' end as skills,
  case when user_id % 2 = 1 then '互联网,金融' else '' end as industries, stage, case when user_id % 2 = 1 then '硕士' end as education, greatest(5, least(30, daily_limit)) as daily_limit,
  role <> '' or user_id % 2 = 1 or user_id % 2 = 0 as ready from r_prefs""")
def _(t):
    j = lambda c, a: F.array_join(c, ",").alias(a)
    return profiles_of(t).select("user_id", F.col("profile_scope").alias("scope"), j("target_regions", "regions"), j("target_roles", "roles"), j("target_locations", "cities"), j("skills", "skills"),
                                 j("target_industries", "industries"), "stage", F.col("highest_education").alias("education"), "daily_limit", "ready")


@query("resolve_intensity", """select user_id, case when manual and age < 30 then 'passive' when acts > 0 or o <= 3 then 'active' when o > 14 then 'passive' when o is not null then case when comp then 'active' else 'passive' end else 'active' end as intensity,
  case when manual and age < 30 then 'user' when acts > 0 or o is not null then 'auto' else 'default' end as source from (select c_custkey as user_id, c_custkey % 4 = 0 as manual, c_custkey % 60 as age, case when c_custkey % 5 = 0 then 1 else 0 end as acts, case when c_custkey % 3 = 0 then c_custkey % 20 end as o, c_custkey % 2 = 0 as comp from customer)""")
def _(t):
    c = t.customer.withColumn("n", at(NOW))
    ago = lambda d: F.expr(f"timestamp '{NOW}' - make_interval(0, 0, 0, cast({d} as int))")
    r = SC.resolve_intensity(F.lit("passive"), F.expr("case when c_custkey % 4 = 0 then 'user' else 'auto' end"), ago("c_custkey % 60"),
                             F.when(F.col("c_custkey") % 3 == 0, ago("c_custkey % 20")), F.expr("case when c_custkey % 5 = 0 then 1 else 0 end"), F.expr("c_custkey % 2 = 0"), NOW)
    return c.select(F.col("c_custkey").alias("user_id"), r["intensity"].alias("intensity"), r["source"].alias("source"))


DEADLINE = "case deadline when '2001-08-10' then 8 when '8月20日截止' then 18 when '2001-12-31' then 151 end"


@query("signals", f"""select id, concat_ws(',', case when status in ('expired', 'removed', 'error') then 'CLOSED_OR_STALE' end, case when status = 'active' and {DEADLINE} <= 13 then 'DEADLINE_SOON' end,
  case when status = 'active' and coalesce(enrich_checked_at >= {N} - interval 24 hour, false) then 'STILL_OPEN' end, case when status = 'active' and not coalesce(enrich_checked_at >= {N} - interval 24 hour, false) then 'OPEN_UNVERIFIED' end) as signals from r_posts""")
def _(t):
    s = SC.signals(NOW, F.lit("校招"))
    return t.posts.select("id", F.concat_ws(",", F.transform(s, lambda x: x["type"])).alias("signals"))


FEED_NOW = "2001-06-01 00:00:00"


@query("recall_pairs")
def _(t):
    return FD.recall(FD.with_query_sets(profiles_of(t).where("ready")), t.jobs, actions_of(t), FEED_NOW)


def actions_of(t):
    """Actions on postings of the job role."""
    ids = C.latest_per_key(t.posts.select("id", F.col("l_orderkey").alias("k")), ["k"], [F.col("id")])
    return t.actions.withColumn("k", F.col("job_id")).drop("job_id").join(ids.withColumnRenamed("id", "job_id"), "k").drop("k")


@query("daily_feed")
def _(t):
    out = FD.daily_feed(profiles_of(t), t.jobs, t.sources, actions_of(t), FEED_NOW)
    return out.select("user_id", "section", "position", "id", "score", "primary_type", "is_new")


@query("eligibility_counts")
def _(t):
    p = FD.with_query_sets(profiles_of(t).where("ready"), None, True)
    return FD.filtered_counts(FD.scored_candidates(p, t.jobs, t.sources, checkpointed(actions_of(t)), FEED_NOW))


SCORED = f"""select id, user_id, title, company, location, first_seen_at, score from (select j.id, j.title, j.company, j.location, j.first_seen_at, j.l_orderkey % 50 as user_id, (j.l_partkey % 71) + 30 as score from r_posts j where j.status = 'active')"""


def opps_of(t):
    return t.sql(SCORED.replace("r_posts j", "{r_posts} j"))


@query("diverse_top", f"""with s as ({SCORED}), a as (select *, case when row_number() over (partition by user_id, company order by score desc, first_seen_at desc, id) > 6 then 1 else 0 end as over_cap from s), b as (select *, row_number() over (partition by user_id order by over_cap, score desc, first_seen_at desc, id) as pick from a) select user_id, id, pick from b where pick <= 20""")
def _(t):
    return FD.diverse_top(opps_of(t), ["user_id"], "company", FD.score_order(), 20).select("user_id", "id", "pick")


KEY = "case when coalesce(trim(location), '') = '' then concat('id:', id) else concat('semantic:', P(company), '|', P(title), '|', regexp_replace(P(location), '市$', '')) end"
for _c in ("company", "title", "location"):
    KEY = KEY.replace(f"P({_c})", f"regexp_replace(lower({_c}), '[\\s\\p{{P}}]+', '', 'g')")


@query("semantic_dedupe", f"with s as ({SCORED}) select user_id, id from (select *, row_number() over (partition by user_id, {KEY} order by score desc, first_seen_at desc, id) rn from s) where rn = 1")
def _(t):
    o = opps_of(t).withColumn("semantic", SC.semantic_key("company", "title", "location", "id")).withColumn("display_rank", F.lit(1)).withColumn("primary_priority", F.lit(3))
    return FD.semantic_dedupe(o).select("user_id", "id")


@query("section_feed", f"""with s as (select *, user_id % 2 = 0 as act, case when l_k % 11 = 0 then 'C' when l_k % 5 = 0 then 'W' else 'M' end as kind from (select j.id, j.title, j.company, j.location, j.first_seen_at, j.l_orderkey % 50 as user_id, (j.l_partkey % 71) + 30 as score, j.l_partkey as l_k from r_posts j where j.status = 'active')),
  g as (select *, case when kind = 'C' then 0 when kind = 'M' and score >= (case when act then 45 else 70 end) then 1 when act and kind = 'M' and l_k % 2 = 0 and score < 45 then 2 when kind = 'W' then 3 else 4 end as dr from s),
  d as (select * from (select *, row_number() over (partition by user_id, {KEY} order by dr, score desc, first_seen_at desc, id) rn from g) where rn = 1 and dr < 4),
  l as (select *, case dr when 0 then 2147483647 when 1 then case when act then 20 else 10 end when 2 then 5 else 8 end as lim from d),
  a as (select *, case when dr in (1, 2) and row_number() over (partition by user_id, dr, company order by score desc, first_seen_at desc, id) > greatest(2, ceil(lim * 0.3)) then 1 else 0 end as over_cap from l)
  select user_id, case dr when 0 then 'critical' when 1 then 'main' when 2 then 'explore' else 'waiting' end as section, id, position from (select *, row_number() over (partition by user_id, dr order by over_cap, score desc, first_seen_at desc, id) as position from a) where position <= lim""")
def _(t):
    o = t.posts.where("status = 'active'").select("id", "title", "company", "location", "first_seen_at", (F.col("l_orderkey") % 50).alias("user_id"), ((F.col("l_partkey") % 71) + 30).alias("score"), F.col("l_partkey").alias("k"))
    sig = lambda p, n, c: F.array(F.struct(F.lit(p).alias("priority"), F.lit(n).alias("type"), F.lit(c).alias("critical")))
    o = o.withColumn("signals", F.when(F.col("k") % 11 == 0, sig(1, "CLOSED_OR_STALE", True)).when(F.col("k") % 5 == 0, sig(1, "CLOSED_OR_STALE", False)).otherwise(sig(3, "STILL_OPEN", False)))
    o = o.withColumn("intensity", F.when(F.col("user_id") % 2 == 0, "active").otherwise("passive")).withColumn("explore_ok", F.col("k") % 2 == 0).withColumn("daily_limit", F.lit(20))
    return FD.section_feed(o).select("user_id", "section", "id", "position")


@query("weighted_round_robin", f"""with s as (select j.id, j.l_orderkey % 50 as user_id, j.l_linenumber % 3 as tier, j.first_seen_at from r_posts j), r as (select *, row_number() over (partition by user_id, tier order by first_seen_at desc, id) as rn from s)
  select user_id, id from (select *, row_number() over (partition by user_id order by rn / (case tier when 0 then 5.0 when 1 then 2.0 else 3.0 end), tier) as k from r where rn <= 90) where k <= 90""")
def _(t):
    s = t.posts.select("id", (F.col("l_orderkey") % 50).alias("user_id"), (F.col("l_linenumber") % 3).alias("tier"), "first_seen_at")
    return C.weighted_round_robin(s, ["user_id"], "tier", [F.col("first_seen_at").desc(), F.col("id")], FD.weight_of("tier"), 90).select("user_id", "id")


@query("critical_alerts", f"""with ids as (select l_orderkey as k, min(id) as job_id from r_posts group by l_orderkey), a as (select a.user_id, ids.job_id, a.action from r_actions a join ids on ids.k = a.job_id where action in ('saved', 'applied'))
  select distinct user_id, id from a join r_posts j on j.id = a.job_id where status in ('expired', 'removed') or {DEADLINE} <= 6 """)
def _(t):
    return FD.critical_alerts(actions_of(t), t.posts, "2001-08-02 00:00:00").select("user_id", "id")


@query("user_lists", """with ids as (select l_orderkey as k, min(id) as job_id from r_posts group by l_orderkey), a as (select distinct a.user_id, ids.job_id from r_actions a join ids on ids.k = a.job_id where action = 'saved')
  select user_id, job_id, title, status from a join r_posts j on j.id = a.job_id""")
def _(t):
    return FD.user_lists(actions_of(t), t.posts, "saved").select("user_id", "job_id", "title", "status")


@query("except_actioned", "select user_id, id from (select l_orderkey % 50 as user_id, l_orderkey % 997 as id from lineitem group by all) where not exists (select 1 from r_actions a where a.user_id = user_id and a.job_id = id and a.action <> 'viewed')".replace("a.user_id = user_id and a.job_id = id", "a.user_id = x.user_id and a.job_id = x.id").replace("group by all) where", "group by all) x where"))
def _(t):
    c = t.lineitem.select((F.col("l_orderkey") % 50).alias("user_id"), (F.col("l_orderkey") % 997).alias("id")).distinct()
    return c.join(t.actions.where("action <> 'viewed'").select("user_id", F.col("job_id").alias("id")).distinct(), ["user_id", "id"], "left_anti")


@query("merge_recall", """with p as (select distinct l_orderkey % 50 as user_id, l_partkey as id from lineitem where l_partkey < l_orderkey % 50 * 4), f as (select distinct l_orderkey % 50 as user_id, l_partkey as id from lineitem where l_linenumber = 1), n as (select user_id, count(*) n from p group by 1),
  b as (select user_id, id, min(part) as part from (select *, 0 as part from p union all select f.*, 1 from f left join n using (user_id) where coalesce(n, 0) < 50) group by all having true) select user_id, id from (select *, row_number() over (partition by user_id order by part, id) rn from b) where rn <= 200""".replace("group by all having true", "group by user_id, id"))
def _(t):
    l = t.lineitem.select((F.col("l_orderkey") % 50).alias("user_id"), F.col("l_partkey").alias("id"), "l_linenumber", "l_orderkey")
    p = l.where("id < user_id * 4").select("user_id", "id").distinct()
    f = l.where("l_linenumber = 1").select("user_id", "id").distinct()
    return FD.merge_recall(p, f, [F.col("id")])


@query("merge_by_url", "select canon, min(part) as part from (select jd_url as canon, 0 as part from r_posts where l_linenumber = 1 union all select jd_url, 1 from r_posts where l_linenumber <> 1) group by 1")
def _(t):
    a = t.posts.where("l_linenumber = 1").select(F.col("jd_url").alias("canon"), F.lit(0).alias("part"))
    b = t.posts.where("l_linenumber <> 1").select(F.col("jd_url").alias("canon"), F.lit(1).alias("part"))
    return C.union_first([a, b], ["canon"])


@query("filter_raw_jobs", f"""select id from r_posts where contains(coalesce(location, ''), '北京') and (case when {Q.rules("lower(concat(title, ' '))", V.JOB_TYPE_RULES)} is null then regexp_matches(lower(coalesce(job_type, '')), '实习|intern') else {Q.rules("lower(concat(title, ' '))", V.JOB_TYPE_RULES)} in ('暑期实习', '日常实习', '实习') end) and not contains(lower(title), 'anvil')""")
def _(t):
    return S.filter_raw_jobs(t.posts.withColumn("summary", F.lit(None).cast("string")), "", "北京", "实习", ["Anvil"]).select("id")


@query("proven_companies")
def _(t):
    return S.proven_companies(S.keyword_exact(t.jobs.where("status = 'active' and location = '北京'"), "产品经理"), "社招")


def me(t):
    return FD.with_query_sets(profiles_of(t).where("user_id = 2"))


@query("search_page")
def _(t):
    f = S.Filters(keyword="产品经理 算法", city="北京")
    return S.search(FD.with_search_doc(t.jobs), f, me(t), actions_of(t).where("user_id = 2"), FEED_NOW, 0, 50).select("id", "tier", "keyword_tier", "match_score")


@query("search_totals")
def _(t):
    return S.search_totals(FD.with_search_doc(t.jobs), S.Filters(keyword="产品经理"), me(t), actions_of(t).where("user_id = 2"), FEED_NOW)


@query("scan_search", f"""select case when fnd = 'exact' and coalesce(location, '') <> '' then 'exact' else 'related' end as tier, count(*) as n from (select *, {tier_sql(3)} as fnd from (select *, {JOBFN} as fn, {Q.fold('title')} as tt, {BODY} as bb, {ALL} as aa from r_jobs
  where status = 'active' and coalesce(job_scope, 'domestic') = 'domestic' and (coalesce(location, '') = '' or contains(location, '深圳') or contains(lower(location), 'shenzhen')))) where fnd is not null group by 1""")
def _(t):
    return S.scan_search(t.jobs, S.Filters(keyword="产品", city="深圳"), NOW).groupBy("tier").agg(F.count("*").alias("n"))


@query("relevant_sources", """select id, (case when contains(lower(concat_ws(' ', company, industry, segment)), 'asia') then 20 else 0 end) + (case when adapter_name in ('greenhouse', 'lever', 'ashby') then 5 else 0 end) as score from r_sources where enabled order by score desc, id limit 12""")
def _(t):
    return S.relevant_sources(t.sources, "asia").select("id", "score")


@query("refresh_scope", """with s as (select id, adapter_name, lower(regexp_extract(source_url, '^https?://([^/?#]+)', 1)) as host, (case when id % 7 = 0 then 5000 when id % 5 = 0 then 3000 else 0 end) + (case when adapter_name in ('moka', 'hotjob', 'beisen') then 100 else 0 end) + (case when contains(lower(concat_ws(' ', company, industry, segment)), 'asia') then 30 else 0 end) as score from r_sources where enabled and not contains(lower(company), '#000000011')),
  a as (select *, case when row_number() over (partition by adapter_name, host order by score desc, id) > 3 then 1 else 0 end as o from s where score > 0) select id, score from a order by o, score desc, id limit 25""")
def _(t):
    proven = t.sources.where("id % 7 = 0 or id % 5 = 0").select(F.lower("company").alias("company"), (F.col("id") % 7 == 0).alias("exact"))
    return S.refresh_scope(t.sources, [], ["asia"], ["#000000011"], "", proven).select("id", "score")


@query("company_industry", "select s_name as company, case when s_suppkey < 5 then '金融' when s_suppkey % 4 = 0 then '医疗/医药' when s_suppkey % 4 = 1 then '物流/供应链' when s_suppkey % 4 = 2 then '教育' end as industry from supplier")
def _(t):
    names = t.supplier.select("s_name", "s_suppkey", F.expr("concat(s_name, case s_suppkey % 4 when 0 then '制药' when 1 then ' Logistics' when 2 then '学院' else '' end)").alias("company"))
    over = t.supplier.where("s_suppkey < 5").select(F.col("s_name").alias("name"), F.lit("金融").alias("industry"), F.col("s_suppkey").alias("pos"))
    return names.join(KW.company_industry(names, over), "company").select(F.col("s_name").alias("company"), "industry")


@query("capital_origin", "select s_suppkey as id, case s_suppkey % 4 when 0 then '德企' when 1 then '中国' when 2 then '外企' else '中国' end as origin from supplier")
def _(t):
    n = F.expr("concat(case s_suppkey % 4 when 0 then 'Siemens ' when 1 then '腾讯' else '' end, s_name)")
    return t.supplier.select(F.col("s_suppkey").alias("id"), KW.capital_origin(n, F.expr("case when s_suppkey % 4 = 2 then 'lever' else 'moka' end")).alias("origin"))
