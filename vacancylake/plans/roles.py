"""The given tables read in the roles the operators work on.

Each statement runs unchanged in Spark and in any ANSI engine; ``{name}`` marks an
input table. They only rename and derive: no rows are dropped, no text is cut.
"""
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

NOW = "2001-08-02 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"

ROLE_SQL = {}

# postings without their body text: a line item is a posting, its supplier the company
ROLE_SQL["r_posts"] = """
select concat_ws('-', cast(l.l_orderkey as string), cast(l.l_linenumber as string), cast(l.l_partkey as string),
                 cast(l.l_suppkey as string)) as id,
  l.l_suppkey as source_id, s.s_name as company,
  concat(case p.p_size % 10 when 0 then 'Senior Software Engineer' when 1 then '产品经理' when 2 then '数据分析实习生'
    when 3 then '算法工程师' when 4 then 'Marketing Manager' when 5 then '2027届校园招聘 销售管培生'
    when 6 then '前端开发工程师' when 7 then 'Product Manager Intern' when 8 then 'HR 招聘专员'
    else '财务分析 Graduate Program' end, ' ', p.p_name) as title,
  case s.s_nationkey % 12 when 0 then '北京' when 1 then 'Shanghai, China' when 2 then 'New York, NY'
    when 3 then 'Singapore' when 4 then 'Remote' when 5 then '' when 6 then null when 7 then 'Hong Kong'
    when 8 then '深圳市' when 9 then 'London, United Kingdom' when 10 then 'Taipei, Taiwan' else '杭州·西湖区' end as location,
  case s.s_nationkey % 12 when 0 then 'CN' when 1 then 'CN' when 2 then 'US' when 3 then 'SG' when 7 then 'HK'
    when 8 then 'CN' when 10 then 'TW' when 11 then 'CN' else null end as country_code,
  case when s.s_nationkey % 12 in (2, 3, 4, 10) then 'overseas' when s.s_nationkey % 12 = 6 then null
    else 'domestic' end as job_scope,
  case l.l_linenumber % 6 when 0 then '社招' when 1 then '校招' when 2 then '实习' when 3 then null
    when 4 then p.p_type else 'Full-time' end as job_type,
  concat('https://jobs.example.com/', cast(l.l_suppkey as string),
    case l.l_linenumber % 3 when 0 then '/campus' when 1 then '/social' else '' end,
    '/job/', cast(100000 + l.l_partkey % 997 as string),
    case cast(l.l_quantity as int) % 7 when 0 then '?utm_source=feed' when 1 then '/' when 2 then '?id=3&spm=a.b'
      when 3 then '#top' when 4 then '?GCLID=1&page=2' when 5 then '//?_ga=1' else '' end) as jd_url,
  case l.l_linenumber % 4 when 0 then concat(cast(cast(l.l_quantity as int) as string), '-',
      cast(cast(l.l_quantity as int) + p.p_size as string), 'K')
    when 1 then concat(cast(cast(l.l_quantity as int) * 1000 as string), '-',
      cast((cast(l.l_quantity as int) + p.p_size) * 1000 as string), '元/月')
    when 2 then '面议' else null end as salary_text,
  case when l.l_linenumber % 3 = 0 then null else o.o_orderdate end as posted_at,
  o.o_orderdate as first_seen_at, l.l_shipdate as last_seen_at,
  case when l.l_returnflag = 'R' then 'expired' when l.l_returnflag = 'A' then 'removed' else 'active' end as status,
  case p.p_size % 5 when 0 then '本科及以上，硕士优先' when 1 then '硕士' when 2 then '' when 3 then null else '学历不限' end as education,
  case p.p_size % 4 when 0 then '3-5年' when 1 then '应届/不限' when 2 then null else '5 years of experience' end as experience,
  case p.p_size % 7 when 0 then '2001-08-10' when 1 then '长期有效' when 2 then null when 3 then '2001-12-31'
    when 4 then '2001-07-01' when 5 then '8月20日截止' else '2001-08-15 至 2001-09-15' end as deadline,
  l.l_linenumber % 4 as enrich_fail_count,
  case when l.l_linenumber % 5 = 0 then null else l.l_shipdate end as enrich_checked_at,
  case l.l_linenumber % 3 when 0 then 'none' when 1 then 'available' else 'unknown' end as sponsorship_signal,
  l.l_orderkey, l.l_partkey, l.l_linenumber
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {part} p on l.l_partkey = p.p_partkey
join {supplier} s on l.l_suppkey = s.s_suppkey"""

# postings with their body text
ROLE_SQL["r_jobs"] = """
select j.*, d.text as summary from {r_posts} j
left join {documents} d on d.doc_id = j.l_orderkey % (select count(*) from {documents})"""

ROLE_SQL["r_sources"] = """
select s_suppkey as id, s_name as company,
  concat('https://', case s_suppkey % 6 when 0 then 'app.mokahr.com/social-recruitment/' when 1 then 'wecruit.hotjob.cn/SU'
    when 2 then 'www.careers.example.com/campus/' when 3 then 'jobs.example.org/intern/' when 4 then 'app.mokahr.com/apply/'
    else 'talent.example.net/off-campus/' end, cast(s_suppkey as string),
    case when s_suppkey % 6 = 1 then '/pb/social.html' else '' end) as source_url,
  case s_suppkey % 6 when 0 then 'moka' when 1 then 'hotjob' when 2 then 'greenhouse' when 3 then 'beisen' when 4 then 'moka'
    else 'lever' end as adapter_name,
  case s_suppkey % 3 when 0 then 'http' when 1 then 'playwright' else null end as crawl_method,
  s_suppkey % 10 <> 0 as enabled, r_name as segment, n_name as industry
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey"""

ROLE_SQL["r_runs"] = """
select o_orderkey as id, o_orderkey % (select count(*) from {supplier}) as source_id, o_orderdate as started_at,
  case o_orderstatus when 'F' then 'success' when 'O' then 'partial_success' else
    case when o_orderkey % 4 = 0 then 'skipped' else 'failed' end end as status,
  cast(o_orderkey % 97 as int) as jobs_found, cast(o_orderkey % 13 as int) as jobs_created,
  cast(o_orderkey % 29 as int) as jobs_updated,
  case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 120 as int) end as reported_total,
  o_orderstatus = 'F' as coverage_complete,
  case when o_orderkey % 3 = 0 then concat('timeout ', o_orderpriority) when o_orderkey % 3 = 1 then '  ' else null end as error_message,
  case o_custkey % 4 when 0 then 'search' when 1 then 'refresh' when 2 then 'insight' else 'discover' end as mode,
  o_custkey as user_id, o_orderdate as created_at,
  case when o_orderstatus = 'O' then null else o_orderdate + interval '1' hour * (o_orderkey % 9) end as finished_at
from {orders}"""

ROLE_SQL["r_tracks"] = """
select event_id as id, user_id, ts as created_at,
  case event_type when 'click' then 'apply_open' when 'view' then 'job_click' when 'error' then 'resume_parse'
    else event_type end as event,
  concat('{{"result":"', case cast(floor(value) as int) % 4 when 0 then 'alive' when 1 then 'dead' when 2 then 'unknown' else 'error' end,
    '","adapter":"', case user_id % 4 when 0 then 'moka' when 1 then 'beisen' when 2 then 'lever' else 'hotjob' end,
    '","diagnostics":{{"source":"', case when event_id % 3 = 0 then 'llm' else 'rules' end, '"}},"k":',
    coalesce(substr(props, 7, length(props) - 7), '0'), '}}') as payload
from {events}"""

ROLE_SQL["r_actions"] = """
select user_id, cast(event_id % 997 as bigint) as job_id,
  case event_type when 'view' then 'viewed' when 'click' then 'saved' when 'purchase' then 'applied'
    when 'error' then 'ignored' else 'viewed' end as action, ts as created_at, event_id
from {events}"""

ROLE_SQL["r_ops"] = """
select event_id as id, case event_type when 'view' then 'crawl' when 'click' then 'insight' when 'purchase' then 'gap_funnel'
    when 'error' then 'enrich' else 'discover' end as module,
  ts as created_at, case cast(floor(value) as int) % 3 when 0 then 'success' when 1 then 'failed' else 'idle' end as status,
  case cast(floor(value) as int) % 5 when 0 then concat('{{"added":"', cast(event_id % 7 as string), '"}}') when 1 then '{{}}'
    else concat('{{"added":', cast(event_id % 7 as string), ',"seen":', cast(event_id % 11 as string), '}}') end as metrics
from {events}"""

ROLE_SQL["r_prefs"] = """
select c_custkey as user_id, case c_custkey % 3 when 0 then 'domestic' when 1 then 'overseas' else 'all' end as job_scope,
  case c_custkey % 5 when 0 then '产品经理' when 1 then 'engineer' when 2 then '数据分析' when 3 then 'marketing' else '' end as role,
  case c_custkey % 4 when 0 then '北京' when 1 then 'Shanghai' when 2 then '深圳' else '' end as city,
  case when c_custkey % 7 = 0 then c_mktsegment else '' end as exclude,
  case c_custkey % 3 when 0 then '实习' when 1 then '校招' else '' end as stage,
  n_name as industry, cast(c_custkey % 40 as int) as daily_limit
from {customer} join {nation} on c_nationkey = n_nationkey"""

# watch list: the brands a list names, by a piece of the company name
ROLE_SQL["r_list"] = """
select cast(s_suppkey as int) as pos, concat('Brand', cast(s_suppkey as string)) as name,
  concat('%', right(s_name, 2), '%') as pattern, right(s_name, 2) as needle, n_name as industry
from {supplier} join {nation} on s_nationkey = n_nationkey"""

ROLE_SQL["r_snaps"] = """
select l_suppkey as source_id, date_trunc('month', l_shipdate) as captured_at, count(*) as campus_count
from {lineitem} group by l_suppkey, date_trunc('month', l_shipdate)"""

ROLE_SQL["r_subs"] = """
select d.doc_id as id, d.source as company, case when l.quality is null then null else l.quality * 4 + 1 end as rating,
  case when l.toxic = 0 then 'approved' when l.toxic = 1 then 'rejected' else 'pending' end as status, d.text as content, d.lang
from {documents} d left join {labels} l on d.doc_id = l.doc_id"""

ROLE_SQL["r_claims"] = """
select o_orderkey as id, o_custkey % 50 as company_id, case o_orderkey % 2 when 0 then '秋招' else '春招' end as season,
  case o_orderkey % 3 when 0 then '提前批' when 1 then '正式批' else '补录' end as batch,
  case o_orderkey % 2 when 0 then 'open' else 'close' end as event,
  cast(o_orderkey % 12 as int) + 1 as month_start,
  cast(case when (o_orderkey % 12) + 1 + o_custkey % 3 > 12 then 12 else (o_orderkey % 12) + 1 + o_custkey % 3 end as int) as month_end,
  concat('site', cast(o_custkey % 17 as string), '.example.com') as publisher,
  cast(o_orderdate as date) as date_start, case o_orderstatus when 'F' then 'verified' when 'O' then 'draft' else 'rejected' end as verify_status,
  cast(o_orderdate + interval '365' day as date) as valid_until
from {orders}"""

# links of all kinds of sources, with the page behind them
ROLE_SQL["r_links"] = """
select page_id, html, page_id % 5 as page_kind, case page_id % 24
  when 0 then concat('https://boards.greenhouse.io/acme', cast(page_id % 7 as string), '/jobs/', cast(page_id as string))
  when 1 then regexp_replace(url, '^https?://[^/]+', 'https://jobs.lever.co') when 2 then regexp_replace(url, '^https?://[^/]+', 'https://careers.tencent.com')
  when 3 then concat('https://app.mokahr.com/campus_apply/tenant', cast(page_id % 5 as string), '/', cast(page_id as string), '#/jobs')
  when 4 then concat('https://www.linkedin.com/jobs/view/', cast(page_id as string)) when 5 then concat('https://zhuanlan.zhihu.com/p/', cast(page_id as string))
  when 6 then concat('https://career.tsinghua.edu.cn/jobfair/jobs/', cast(page_id as string)) when 7 then concat('https://www.school.edu.cn/%E5%B0%B1%E4%B8%9A/', cast(page_id as string))
  when 8 then concat('https://acme', cast(page_id % 3 as string), '.wd1.myworkdayjobs.com/en-US/ext') when 9 then concat('https://jobs.ashbyhq.com/acme', cast(page_id % 3 as string))
  when 10 then concat('https://careers.smartrecruiters.com/Acme', cast(page_id % 3 as string)) when 11 then regexp_replace(url, '^https?://[^/]+/[a-z]+/', 'https://careers.example.com/students/role-')
  when 12 then concat('https://xiaomi.jobs.feishu.cn/campus/position/', cast(page_id as string), '/detail') when 13 then concat('https://acme.feishu.cn/docs/', cast(page_id as string))
  when 14 then concat('https://jobs.acme.com.cn:8443/position/detail?id=', cast(page_id as string)) when 15 then concat('  https://user@hr.example.cn/', cast(page_id as string), '/招聘  ')
  when 16 then 'http://hr.163.com/' when 17 then concat('no link ', cast(page_id as string)) when 18 then concat('https://acme.zhiye.com/social/', cast(page_id as string))
  when 19 then concat('https://talent.baidu.com/jobs/detail/SOCIAL/', cast(page_id as string)) when 20 then concat('https://www.example.com/blog/', cast(page_id as string))
  when 21 then concat('https://acme.greenhouse.io/?for=board', cast(page_id % 4 as string)) when 22 then concat('https://example.com/careers/list?page=2&amp;x=', cast(page_id as string))
  else url end as url
from {pages}"""

# documents read as resumes: a headline and a skill line before the text, a school or project line after it
ROLE_SQL["r_resumes"] = """
select doc_id, concat(case doc_id % 6 when 0 then '求职意向：数据分析实习生' when 1 then '  产品经理   校招 ' when 2 then '  ' when 3 then 'Business Analyst intern in 上海'
    when 4 then '期望岗位: 算法  NLP' else '张三' end, chr(13), case doc_id % 5 when 0 then '技能：Python、SQL、Power BI' when 1 then '熟练掌握 Tableau 与 Excel' when 2 then ''
    when 3 then '深圳 北京 电商平台 用户增长' else '大模型 RAG Prompt' end, chr(10), case when doc_id % 9 = 0 then '' else coalesce(text, '') end, chr(10),
  case doc_id % 7 when 0 then '教育：某大学 本科' when 1 then '负责项目 A/B 实验' when 2 then concat('某公司', chr(9), '工作经历') else '' end) as text
from {documents}"""

# results of search queries: thirteen to a query, two queries to a provider, two providers to a run
ROLE_SQL["r_results"] = """
select page_id, cast(floor(page_id / 52.0) as bigint) as run_id, case when cast(floor(page_id / 26.0) as bigint) % 2 = 0 then 'baidu' else 'bing' end as provider,
  cast(floor(page_id / 13.0) as bigint) as q, page_id % 13 as n, case when page_id % 29 = 0 then '' else url end as url,
  concat('T', cast(page_id as string)) as title, case when page_id % 3 = 0 then '' else concat('s', cast(page_id as string)) end as snippet
from {r_links}"""

ROLE_SQL["r_diags"] = """
select run_id, provider, q as pos, concat('q', cast(q as string)) as query, case q % 5 when 0 then 'provider_failed' when 1 then 'no_results' else 'success' end as status,
  cast(case q % 7 when 0 then 429 when 1 then null when 2 then 0 else 200 end as int) as http_status, count(*) as raw_results_count, case when q % 5 = 0 then 0 else count(*) - 1 end as extracted_urls_count,
  case q % 4 when 0 then 'timeout' when 1 then concat('limit 429 x', cast(q % 2 as string)) when 2 then '' else null end as error, q % 11 = 0 as rate_limited
from {r_results} group by run_id, provider, q"""

# items of companies by dimension, and the companies a user looks at
ROLE_SQL["r_items"] = """
select company_id, case id % 5 when 0 then 'timing' when 1 then 'timing' when 2 then 'compensation_intensity' when 3 then 'culture' else 'path' end as dimension, id as pos,
  case id % 6 when 0 then concat(cast(month_start as string), '–', cast(month_end as string), ' 月') when 1 then concat('HC 偏紧 ', cast(month_start as string), '月') when 2 then '全年滚动'
    when 3 then concat(cast(month_end as string), '到', cast(month_start as string), '月、1 月') when 4 then '不定' else null end as time_window,
  case when id % 4 = 0 then '  ' when id % 4 = 1 then null else concat('note ', cast(id % 9 as string)) end as title, concat(batch, season, publisher, batch, season, publisher, event) as content
from {r_claims}"""

# suppliers as entities, filers and reports of public registers, in the JSON those publish
ROLE_SQL["r_register"] = """
select s_suppkey as company_id, s_name, concat('{{"id":"Q', cast(s_suppkey as string), '","labels":{{"en":{{"value":"', s_name, '"}}', case when s_suppkey % 3 = 0 then concat(',"zh":{{"value":"公司', cast(s_suppkey as string), '"}}') else '' end,
  '}},"claims":{{"P31":[', case when s_suppkey % 4 = 2 then '{{"mainsnak":{{"datavalue":{{"value":{{"id":"Q891723"}}}}}}}}' else '{{"mainsnak":{{}}}}' end, '],"P414":[',
  case s_suppkey % 4 when 0 then '{{"mainsnak":{{"datavalue":{{"value":{{"id":"Q13677"}}}}}}}},{{"mainsnak":{{"datavalue":{{"value":{{"id":"Q82059"}}}}}}}},{{"mainsnak":{{"datavalue":{{"value":{{"id":"Q174687"}}}}}}}}'
    when 1 then '{{"mainsnak":{{"datavalue":{{"value":{{"id":"Q999"}}}}}}}}' else '' end, '],"P249":[', case when s_suppkey % 5 = 0 then '' else concat('{{"mainsnak":{{"datavalue":{{"value":7}}}}}},{{"mainsnak":{{"datavalue":{{"value":"T', cast(s_suppkey as string), '"}}}}}}') end,
  '],"P571":[', case s_suppkey % 3 when 0 then '{{"mainsnak":{{"datavalue":{{"value":{{"time":"+1799-00-00T00:00:00Z"}}}}}}}},{{"mainsnak":{{"datavalue":{{"value":{{"time":"+2001-04-00T00:00:00Z"}}}}}}}}' when 1 then '{{"mainsnak":{{"datavalue":{{"value":{{"time":"+1987-01-01T00:00:00Z"}}}}}}}}' else '' end,
  '],"P1128":[', case when s_suppkey % 2 = 0 then concat('{{"mainsnak":{{"datavalue":{{"value":{{"amount":"+', cast(s_suppkey * 100 + 1 as string), '"}}}}}},"qualifiers":{{"P585":[{{"datavalue":{{"value":{{"time":"+2020-01-01T00:00:00Z"}}}}}}]}}}},{{"mainsnak":{{"datavalue":{{"value":{{"amount":"+9"}}}}}},"qualifiers":{{"P585":[{{"datavalue":{{"value":{{"time":"+2010-01-01T00:00:00Z"}}}}}}]}}}},{{"mainsnak":{{"datavalue":{{"value":{{"amount":"5"}}}}}}}}')
    else '{{"mainsnak":{{"datavalue":{{"value":{{"amount":"x"}}}}}}}}' end, '],"P159":[{{"mainsnak":{{"datavalue":{{"value":{{"id":"Q1"}}}}}}}},{{"mainsnak":{{"datavalue":{{"value":{{"id":"Q', cast(500 + s_suppkey % 7 as string), '"}}}}}}}}]}}}}') as entity,
  concat('{{"name":" ', s_name, ' ","cik":', case when s_suppkey % 3 = 0 then 'null' else cast(s_suppkey as string) end, ',"exchanges":', case when s_suppkey % 5 = 0 then '[null,""]' else '["NYSE",null,"Nasdaq","NYSE"]' end, ',"tickers":["AB", "CD"],"filings":{{"recent":{{"form":["8-K","10-K","10-K/A"],"filingDate":["2024-01-0',
    cast(s_suppkey % 9 as string), '","2024-01-05","2024-01-05"]}}}}}}') as submissions, case when s_suppkey % 4 = 0 then null else concat('nyse: t', cast(s_suppkey as string)) end as ticker,
  concat('{{"facts":{{"us-gaap":{{"', case when s_suppkey % 2 = 0 then 'Revenues' else 'SalesRevenueNet' end, '":{{"units":{{"USD":[{{"fy":2021,"fp":"FY","form":"10-K","val":', cast(s_suppkey * 7 + 100 as string), ',"end":"2021-12-31"}},{{"fy":2020,"fp":"FY","form":"20-F","val":',
    cast(s_suppkey * 5 + 50 as string), '.5,"end":"2020-12-31"}},{{"fy":2021,"fp":"FY","form":"10-K","val":"x","end":"2022-12-31"}},{{"fy":2021,"fp":"Q3","form":"10-Q","val":1,"end":"2022-09-30"}}', case when s_suppkey % 6 = 0 then concat(',{{"fy":2022,"fp":"FY","form":"10-K","val":', cast(s_suppkey * 9 + 100 as string), ',"end":"2021-12-31"}}') else '' end, ']}}}}',
    case when s_suppkey % 3 = 0 then concat(',"NetIncomeLoss":{{"units":{{"USD":[{{"fy":2019,"fp":"FY","form":"40-F","val":-', cast(s_suppkey as string), ',"end":"2019-12-31"}}]}}}}') else '' end, '}},"dei":{{"EntityNumberOfEmployees":{{"units":{{"pure":[{{"val":12,"end":"2019-01-01"}},{{"val":', cast(s_suppkey + 30 as string), ',"end":"2020-01-01"}}]}}}}}}}}}}') as report
from {supplier}"""
