"""Column functions over whole tables."""
from pyspark.sql import functions as F

from ..functions import company as CO, dates as D, fixed as V, geo as G, text as T, urls as U
from ..functions.base import at, shanghai_date
from ..operators import core as C
from . import sqlgen as S
from .registry import query
from .roles import NOW

LOC = "concat(coalesce(location, ''), case when l_linenumber % 3 = 0 then ' / Remote' when l_linenumber % 3 = 1 then '' else ' Office' end)"


def loc(t):
    return t.posts.withColumn("place", F.expr(LOC))


@query("city_normalize", f"select id, {S.city('place')} as city from (select *, {LOC} as place from r_posts)")
def _(t):
    return loc(t).select("id", G.city("place").alias("city"))


@query("clean_location", f"select id, case when lower(trim(coalesce(location, ''))) in ('', 'unknown', 'multiple locations', 'various') then null else {S.city('location')} end as location from r_posts")
def _(t):
    return t.posts.select("id", G.clean_location("location").alias("location"))


@query("country_code", f"select id, {S.country('place')} as country_code, case when {S.country('place')} is null or {S.country('place')} in ('CN', 'HK', 'MO') then 'domestic' else 'overseas' end as job_scope from (select *, {LOC} as place from r_posts)")
def _(t):
    return loc(t).select("id", G.country_code("place").alias("country_code"), G.job_scope("place").alias("job_scope"))


LATIN = "|".join(V.CHINA_LATIN + ["hong kong", "macau", "macao"])
CHINA = f"({S.contains_any('lower(p)', V.CHINA_CJK + ['香港', '澳门'])} or regexp_matches(lower(p), {S.q(chr(92) + 'b(?:' + LATIN + ')' + chr(92) + 'b')}))"
REMOTE = S.contains_any("lower(p)", V.REMOTE_MARKERS)
OVERSEAS = f"({S.contains_any('lower(p)', V.OVERSEAS_PHRASES)} or len(list_intersect(string_split_regex(lower(p), '[^a-z]+'), [{', '.join(S.q(w) for w in V.OVERSEAS_WORDS)}])) > 0)"


@query("place_tests", f"select id, {CHINA} as is_china, {REMOTE} as is_remote, {OVERSEAS} as is_overseas, ({CHINA} or ({REMOTE} and not {OVERSEAS})) as keep from (select id, coalesce({LOC}, '') as p from r_posts)")
def _(t):
    p = F.col("place")
    return loc(t).select("id", G.is_china(p).alias("is_china"), G.is_remote(p).alias("is_remote"),
                         G.is_overseas(p).alias("is_overseas"), G.keep_for_china(p).alias("keep"))


@query("company_api_location", f"select id, (trim(p) <> '' and not {S.contains_any('p', V.COMPANY_API_FOREIGN)} and ({CHINA} or contains(p, '全国') or contains(p, '多省') or {S.contains_any('p', V.COMPANY_API_CITIES)} or regexp_matches(trim(p), '(省|市|自治区|特别行政区|自治州|地区|盟|新区)$'))) as in_china from (select id, coalesce(location, '') as p from r_posts)")
def _(t):
    return t.posts.select("id", G.is_china_company_location("location").alias("in_china"))


@query("location_in_regions", f"""select id, case when {S.country('place')} is not null then list_contains(rg, {S.country('place')}) or (list_contains(rg, 'CN') and {S.country('place')} in ('CN', 'HK', 'MO'))
  when {S.contains_any("lower(coalesce(place, ''))", V.REMOTE_MARKERS)} then list_contains(rg, 'Remote') or list_contains(rg, 'CN') else false end as ok
  from (select id, {LOC} as place, case source_id % 3 when 0 then ['CN'] when 1 then ['US', 'SG'] else ['Remote'] end as rg from r_posts)""")
def _(t):
    rg = F.expr("case source_id % 3 when 0 then array('CN') when 1 then array('US', 'SG') else array('Remote') end")
    return loc(t).withColumn("rg", rg).select("id", G.location_in_scope("place", "rg").alias("ok"))


TS = "lower(concat(title, ' ', coalesce(job_type, '')))"


@query("job_type", f"select id, {S.rules(TS, V.JOB_TYPE_RULES)} as job_type, {S.contains_any('lower(trim(job_type))', V.RECRUIT_TYPE_WORDS)} as is_type from (select id, title, coalesce(job_type, '') as job_type from r_posts)")
def _(t):
    return t.posts.select("id", T.job_type("title", "job_type").alias("job_type"), T.is_recruitment_type("job_type").alias("is_type"))


@query("job_type_documents", f"select doc_id, {S.rules(S.fold('text'), V.JOB_TYPE_RULES)} as job_type, {S.rules(S.fold('text'), V.JOB_TYPE_FIELD_RULES)} as field_type from documents")
def _(t):
    return t.documents.select("doc_id", T.job_type(F.lit(""), "text").alias("job_type"), T.normalize_job_type("text").alias("field_type"))


@query("job_type_field", f"select id, {S.rules(S.fold('concat_ws(chr(32), title, job_type, jd_url)'), V.JOB_TYPE_FIELD_RULES)} as job_type from r_posts")
def _(t):
    return t.posts.select("id", T.normalize_job_type("title", "job_type", "jd_url").alias("job_type"))


EXP = "regexp_replace(trim(regexp_replace(regexp_replace(coalesce(experience, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+', '', 'g')"


@query("experience_text", f"""select id, case when coalesce(experience, '') = '' then null when regexp_matches({EXP}, '应届|经验不限') then '应届/不限'
   when regexp_extract({EXP}, '(\\d+)[-~至到](\\d+)年', 1) <> '' then concat(regexp_extract({EXP}, '(\\d+)[-~至到](\\d+)年', 1), '-', regexp_extract({EXP}, '(\\d+)[-~至到](\\d+)年', 2), '年')
   when regexp_extract({EXP}, '(?i)(\\d+)\\+?years?', 1) <> '' then concat(regexp_extract({EXP}, '(?i)(\\d+)\\+?years?', 1), '年+') end as experience from r_posts""")
def _(t):
    return t.posts.select("id", T.experience_text("experience").alias("experience"))


@query("min_years", f"select id, {S.min_years('lower(concat_ws(chr(32), title, y))')} as years from (select id, title, case l_linenumber % 5 when 0 then '3-5 years' when 1 then 'at least 2+ years of experience' when 2 then 'Staff level' else null end as y from r_posts)")
def _(t):
    y = F.expr("case l_linenumber % 5 when 0 then '3-5 years' when 1 then 'at least 2+ years of experience' when 2 then 'Staff level' end")
    return t.posts.withColumn("y", y).select("id", T.min_years("title", "y").alias("years"))


EDL = "regexp_replace(text, '\\s+', '', 'g')"


@query("education_level", "select doc_id, case " + " ".join(f"when regexp_matches({EDL}, {S.q('(?i)' + p)}) then '{l}'" for l, _r, p in V.EDUCATION_LEVELS) + " end as level from (select doc_id, regexp_replace(text, '<[^>]+>', ' ', 'g') as text from documents)")
def _(t):
    return t.documents.select("doc_id", T.education_level("text").alias("level"))


@query("education_gate", f"""select id, {S.edu_rank('education')} as rank, {S.edu_floor('education')} as floor,
  case when trim(coalesce(education, '')) = '' then 'degrade' when {S.edu_floor('education')} is null then
    case when len(list_filter({S.edu_clauses('education')}, lambda x: {S.edu_rank('x')} is not null)) > 0 then 'pass' else 'degrade' end
    when {S.edu_floor('education')} > 4 then 'reject' else 'pass' end as verdict from r_posts""")
def _(t):
    return t.posts.select("id", T.education_rank("education").alias("rank"), T.education_floor("education").alias("floor"),
                          T.education_match("education", F.lit("本科")).alias("verdict"))


@query("deadline_text", """select doc_id, case when regexp_matches(text, '(?i)长期有效|长期招聘|long[\\s-]?term|rolling|until filled') then '长期有效'
  when regexp_extract(text, '(?i)(?:截止|截至|申请截止|投递截止|deadline)[^0-9]{0,8}(\\d{4}[-/.年]\\d{1,2}[-/.月]\\d{1,2})', 1) <> '' then
  regexp_replace(regexp_extract(text, '(?i)(?:截止|截至|申请截止|投递截止|deadline)[^0-9]{0,8}(\\d{4}[-/.年]\\d{1,2}[-/.月]\\d{1,2})', 1), '[年月./]', '-', 'g') end as deadline,
  nullif(regexp_extract(text, '(\\d{4}-\\d{2}-\\d{2})', 1), '') as posted
  from (select doc_id, trim(regexp_replace(regexp_replace(concat(text, case doc_id % 3 when 0 then ' Deadline: 2001/9/1' when 1 then ' posted 2001-05-06' else '' end), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as text from documents)""")
def _(t):
    d = t.documents.withColumn("text", F.expr("concat(text, case doc_id % 3 when 0 then ' Deadline: 2001/9/1' when 1 then ' posted 2001-05-06' else '' end)"))
    return d.select("doc_id", D.deadline_text("text").alias("deadline"), D.posted_text("text").alias("posted"))


@query("parse_deadline", f"""select id, case deadline when '2001-08-10' then '2001-08-10' when '2001-12-31' then '2001-12-31' when '2001-07-01' then '2001-07-01'
  when '8月20日截止' then '2001-08-20' end as day, case when deadline = '8月20日截止' then 'medium' when deadline in ('2001-08-10', '2001-12-31', '2001-07-01') then 'high' end as confidence,
  case when deadline in ('2001-08-10', '2001-12-31') then deadline when deadline like '2001-08-15%' then '2001-08-15' end as campus_day from r_posts""")
def _(t):
    p = D.parse_deadline("deadline", NOW)
    return t.posts.select("id", p["date"].cast("string").alias("day"), p["confidence"].alias("confidence"),
                          D.campus_deadline("deadline", NOW).cast("string").alias("campus_day"))


# seconds up to 10^9 are no stamps; their milliseconds are read as seconds of a far year
@query("iso_date", """select l_orderkey, l_partkey, l_linenumber, l_suppkey, case when epoch(l_shipdate) > 1e9 then strftime(l_shipdate, '%Y-%m-%d') end as from_seconds,
  case when epoch(l_shipdate) > 1e9 then strftime(l_shipdate, '%Y-%m-%d') else '+' || strftime(make_timestamp((epoch(l_shipdate) * 1000000000)::bigint), '%Y-%m-%d') end as from_millis,
  strftime(l_shipdate, '%Y-%m-%d') as from_text, cast(null as varchar) as from_junk from lineitem""")
def _(t):
    l = t.lineitem
    sec = F.unix_timestamp("l_shipdate")
    return l.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", D.iso_date(sec).alias("from_seconds"),
                    D.iso_date(sec * 1000).alias("from_millis"), D.iso_date(F.date_format("l_shipdate", "yyyy年M月d日")).alias("from_text"),
                    D.publish_date(F.create_map(F.lit("publish_time"), F.lit("soon"))).alias("from_junk"))


@query("grad_class", "select id, greatest(case when contains(title, '2027届') then 2027 end, case when contains(extra, 'Class of 2026') then 2026 when contains(extra, '28届') then 2028 end) as grad_class from (select id, title, case l_linenumber % 4 when 0 then 'Class of 2026' when 1 then '欢迎28届' when 2 then '2014届' else '2027年12月入职' end as extra from r_posts)")
def _(t):
    extra = F.expr("case l_linenumber % 4 when 0 then 'Class of 2026' when 1 then '欢迎28届' when 2 then '2014届' else '2027年12月入职' end")
    return t.posts.select("id", T.grad_class("title", None, extra).alias("grad_class"))


@query("sponsorship", "select doc_id, case " + " ".join(f"when regexp_matches(text, {S.q('(?i)' + p)}) then 'none'" for p in V.SPONSOR_NONE) + " " + " ".join(
    f"when regexp_matches(text, {S.q('(?i)' + p)}) then 'available'" for p in V.SPONSOR_AVAILABLE) + " else 'unknown' end as signal from (select doc_id, concat(text, case doc_id % 4 when 0 then ' We will sponsor visas.' when 1 then ' Security clearance needed.' when 2 then ' H1B sponsorship' else '' end) as text from documents)")
def _(t):
    d = t.documents.withColumn("text", F.expr("concat(text, case doc_id % 4 when 0 then ' We will sponsor visas.' when 1 then ' Security clearance needed.' when 2 then ' H1B sponsorship' else '' end)"))
    return d.select("doc_id", T.sponsorship("text").alias("signal"))


@query("salary_usd", """select doc_id, case doc_id % 3 when 0 then concat('$', cast(100 + doc_id % 50 as varchar), 'K – $', cast(160 + doc_id % 50 as varchar), 'K') when 1 then concat('$', cast(90000 + doc_id as varchar), ' – $', cast(120000 + doc_id as varchar)) end as pay from documents""")
def _(t):
    d = t.documents.withColumn("text", F.expr("concat(text, case doc_id % 3 when 0 then concat(' <b>Base salary</b>: $', 100 + doc_id % 50, 'K - $', 160 + doc_id % 50, 'K') when 1 then concat(' pay range of $', 90000 + doc_id, ' to $', 120000 + doc_id) else ' bonus $2500 - $3000' end)"))
    return d.select("doc_id", T.salary_usd("text").alias("pay"))


@query("monthly_k", f"select id, m.lo as min_k, m.hi as max_k from (select id, {S.monthly('salary_text')} as m from r_posts)")
def _(t):
    m = T.monthly_k("salary_text")
    return t.posts.select("id", m["min_k"].alias("min_k"), m["max_k"].alias("max_k"))


BUCKET = S.rules("lower(concat(coalesce(job_type, ''), ' ', title))", V.RECRUIT_BUCKET_RULES, "'unknown'")
COARSE = S.rules("title", V.COARSE_FUNCTION_RULES, "'其他'")
CITYHEAD = "nullif(trim(regexp_replace(coalesce(list_filter(string_split_regex(coalesce(location, ''), '[·、,，/\\s-]+'), lambda x: x <> '')[1], ''), '(市|地区)$', '')), '')"


@query("buckets", f"select id, {BUCKET} as bucket, {COARSE} as fn, {CITYHEAD} as city from r_posts")
def _(t):
    return t.posts.select("id", T.recruit_bucket("job_type", "title").alias("bucket"), T.coarse_function("title").alias("fn"),
                          T.city_head("location").alias("city"))


JOBFN = f"case when {S.function_of(S.fold('title'))} not in ('其他', '职能') then {S.function_of(S.fold('title'))} when {S.function_of(S.fold('concat(title, chr(32), coalesce(summary, chr(32)))'))} <> '其他' then {S.function_of(S.fold('concat(title, chr(32), coalesce(summary, chr(32)))'))} else {S.function_of(S.fold('title'))} end"


@query("job_function", f"select id, {JOBFN} as fn from r_jobs")
def _(t):
    return t.jobs.select("id", T.job_function("title", "summary").alias("fn"))


SENIOR = f"coalesce({S.min_years('lower(concat_ws(chr(32), title, summary))')} >= 2, false)"
INT = f"regexp_matches(title, {S.q('(?i)' + V.INTERN_SIGNAL)})"
CAMP = f"regexp_matches(concat(title, ' ', coalesce(summary, '')), {S.q('(?i)' + V.CAMPUS_SIGNAL)})"
CATEGORY = f"""case when {S.declared('job_type')} = '实习' or {INT} or regexp_matches(jd_url, '(?i)/(shixi|intern)(/|\\?|$)') then '实习' when {SENIOR} then '社招'
  when {S.declared('job_type')} is not null then {S.declared('job_type')} when regexp_matches(jd_url, '(?i)/(xiaozhao|campus)([-_][a-z]+)?(/|\\?|$)') then '校招'
  when regexp_matches(jd_url, '(?i)/(social|experienced)([-_][a-z]+)?(/|\\?|$)') then '社招' when {CAMP} then '校招' else '社招' end"""
EXPLICIT = f"({SENIOR} or coalesce(job_type, '') <> '' or regexp_matches(jd_url, '(?i)/(shixi|intern|xiaozhao|campus|social|experienced)(/|\\?|$)') or {INT} or {CAMP})"


@query("recruitment_category", f"select id, {CATEGORY} as category, {EXPLICIT} as explicit from r_jobs")
def _(t):
    a = ("title", "job_type", "summary", "jd_url", "company")
    j = t.jobs.withColumn("senior", T.asks_experience("title", None, "summary"))
    return j.select("id", T.recruitment_category(*a, senior=F.col("senior")).alias("category"),
                    T.has_explicit_type(*a, senior=F.col("senior")).alias("explicit"))


NAMES = "concat(s_name, case s_suppkey % 5 when 0 then '股份有限公司' when 1 then '集团控股' when 2 then ' (China)' when 3 then '科技有限公司' else ' Inc.' end)"
STRIP = lambda s, suf: f"case when regexp_replace({s}, '({'|'.join(suf)})+$', '') = '' then {s} else regexp_replace({s}, '({'|'.join(suf)})+$', '') end"
LOWJ = "regexp_replace(lower(trim(n)), '\\s+', '', 'g')"
MK = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(n)), '（中国）|\\(china\\)|（大中华区）|中国区|大中华区', '', 'g'), '有限公司|股份有限公司|科技有限公司|集团|公司|股份|控股', '', 'g'), '\\b(inc|ltd|llc|co|corp|corporation|company|technologies|technology|holdings|group)\\b', '', 'g'), '[\\s.,，。、_\\-—·&''\"’]', '', 'g')"


@query("company_keys", f"""select id, {STRIP(LOWJ, V.COVER_SUFFIXES)} as cover, {MK} as match, {STRIP("regexp_replace(regexp_replace(lower(trim(n)), '[（(][^（）()]*[）)]', '', 'g'), '\\s+', '', 'g')", V.TARGET_SUFFIXES)} as target, {LOWJ} as industry, lower(trim(n)) as display
  from (select s_suppkey as id, {NAMES} as n from supplier)""")
def _(t):
    n = t.supplier.select(F.col("s_suppkey").alias("id"), F.expr(NAMES).alias("n"))
    return n.select("id", *[CO.company_key("n", r).alias(r) for r in ("cover", "match", "target", "industry", "display")])


@query("name_attribution", """select s_suppkey as id, s_suppkey % 4 <> 2 as ok from supplier""")
def _(t):
    full = F.expr("concat(case s_suppkey % 4 when 0 then '' when 1 then '陕西省' when 2 then '北京华晋' else '上海' end, s_name, '速递有限公司')")
    return t.supplier.select(F.col("s_suppkey").alias("id"), CO.name_matches(full, "s_name").alias("ok"))


BOARD = """case when adapter_name in ('tencent', 'baidu', 'wt', 'beisen') then 'mixed' when adapter_name = 'bytedance_campus' then 'campus' when contains(lower(source_url), 'off-campus') then 'social'
  when regexp_matches(lower(source_url), 'campus|/school|school\\.html|/grad|university|xiaozhao') then 'campus' when regexp_matches(lower(source_url), 'intern|shixi') then 'intern' else 'social' end"""


@query("source_board", f"select id, {BOARD} as board from r_sources")
def _(t):
    return t.sources.select("id", U.source_board("adapter_name", "source_url").alias("board"))


@query("campus_url", """select id, case when adapter_name = 'hotjob' then concat('https://wecruit.hotjob.cn/SU', cast(id as varchar), '/pb/school.html') when adapter_name = 'moka' then concat('https://app.mokahr.com/campus-recruitment/', cast(id as varchar)) end as campus_url,
  case when adapter_name = 'hotjob' then concat('https://wecruit.hotjob.cn/SU', cast(id as varchar)) when adapter_name = 'moka' then cast(id as varchar) end as tenant from r_sources""")
def _(t):
    return t.sources.select("id", U.campus_url("adapter_name", "source_url").alias("campus_url"), U.tenant("adapter_name", "source_url").alias("tenant"))


@query("job_identity", "select id, cast(100000 + l_partkey % 997 as varchar) as identity from r_posts")
def _(t):
    return t.posts.select("id", U.job_identity("jd_url").alias("identity"))


DETAIL_LINK = "case page_id % 4 when 0 then regexp_replace(url, '/(en|de)/', '/job/') when 1 then regexp_replace(url, '^https?://[^/]+', 'https://jobs.lever.co') when 2 then regexp_replace(url, '^https?://[^/]+/[a-z]+', 'https://boards.greenhouse.io/x/jobs') else url end"


@query("detail_urls", f"""with p as (select page_id, {DETAIL_LINK} as u from pages),
  q as (select page_id, lower(regexp_extract(u, '^https?://([^/?#]+)', 1)) as h, regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) as path, lower(regexp_extract(u, '[?]([^#]*)', 1)) as qs from p)
  select page_id, path not in ('', '/') and not regexp_matches(lower(path), '{V.LIST_PATH}') and not (regexp_matches(qs, '{V.LIST_QUERY}') and not regexp_matches(qs, '{V.ID_QUERY}')) and regexp_matches(regexp_replace(lower(path), '[._/-]+', ' ', 'g'), '\\b({"|".join(V.DETAIL_WORDS)})\\b') as generic,
  h = 'jobs.lever.co' and regexp_matches(path, '^/[^/]+/[^/]+') as lever, ends_with(h, 'greenhouse.io') and regexp_matches(path, '/jobs/[^/]+') as greenhouse, false as unknown from q""")
def _(t):
    p = t.pages.select("page_id", F.expr(DETAIL_LINK).alias("u"))
    is_detail = lambda name: U.is_detail_url("u", F.lit(name))
    return p.select("page_id", is_detail("generic_official_detail").alias("generic"), is_detail("lever").alias("lever"), is_detail("greenhouse").alias("greenhouse"), is_detail("other").alias("unknown"))


@query("hosts", f"select page_id, h as host, array_to_string(list_slice(string_split(regexp_replace(h, '^www\\.', ''), '.'), -2, -1), '.') as registrable, false as shared from (select page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as h from pages)")
def _(t):
    h = t.pages.select("page_id", U.host("url").alias("host"))
    return h.select("page_id", "host", U.registrable("host").alias("registrable"), U.is_shared_host("host").alias("shared"))


@query("official_grounding", """with o as (select distinct source as company, concat('therha.example', case when doc_id % 2 = 0 then '.com' else '.net' end) as h from documents), p as (select page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host from pages)
  select p.page_id, o.company, count(*) as hits from p join o on p.host = o.h or ends_with(p.host, concat('.', o.h)) or ends_with(o.h, concat('.', p.host)) group by all""")
def _(t):
    o = t.documents.select(F.col("source").alias("company"), F.expr("concat('therha.example', case when doc_id % 2 = 0 then '.com' else '.net' end)").alias("h")).distinct()
    # both directions by the parent domains of each side: equi-joins, no pairwise comparison
    p = t.pages.select("page_id", U.host("url").alias("host"))
    parents = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda i: F.array_join(F.slice(F.split(c, r"\."), F.size(F.split(c, r"\.")) - i + 1, i), "."))
    up = p.withColumn("h", F.explode(parents("host"))).join(o, "h").select("page_id", "company", "h", "host")
    down = o.withColumn("host", F.explode(parents("h"))).join(p, "host").select("page_id", "company", "h", "host")
    return up.union(down).distinct().groupBy("page_id", "company").agg(F.count("*").alias("hits"))


@query("split_multi", "select c_custkey, array_to_string(list_filter(string_split_regex(concat(c_mktsegment, ', ', 'a b,a，', c_name), '[\\s,，]+'), lambda x: x <> ''), '|') as v from (select *, 1 from customer) where c_mktsegment not in ('a', 'b')".replace("'a b,a，'", "'a b，'"))
def _(t):
    return t.customer.select("c_custkey", F.array_join(T.split_multi(F.concat("c_mktsegment", F.lit(", a b，a "), "c_name")), "|").alias("v"))


@query("shanghai_day", "select event_id, strftime(ts + interval 8 hours, '%Y-%m-%d') as day, strftime(ts, '%m') as utc_month from events")
def _(t):
    return t.base("events").select("event_id", D.shanghai_day("ts").alias("day"), F.date_format("ts", "MM").alias("utc_month"))


@query("claim_expiry", "select id, strftime(valid_until, '%Y-%m-%d') < '2001-08-02' as expired, case when month(date_start) >= 5 then year(date_start) + 1 else year(date_start) end as cohort from r_claims")
def _(t):
    return t.claims.select("id", D.is_expired("valid_until", NOW).alias("expired"), D.cohort(F.col("date_start").cast("timestamp") ).alias("cohort"))


@query("strip_html_pages", """select page_id, length(s) as n, md5(s) as text_md5 from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '&amp;', '&'), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as s from pages)""")
def _(t):
    s = T.clean_summary("html", None)
    return t.pages.select("page_id", F.length(s).alias("n"), F.md5(s).alias("text_md5"))
