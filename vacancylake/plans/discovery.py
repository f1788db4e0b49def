"""Discovery of sources: links, pages, search runs and proposed companies."""
from pyspark.sql import functions as F

from ..functions import fixed as V, fixed_pages as P, pages as PG
from . import sqlgen as S
from .registry import query

WORD = lambda c, words: f"regexp_matches({c}, '(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)')"
UNDER = lambda hosts: "(" + " or ".join(f"host = {S.q(h)} or ends_with(host, {S.q('.' + h)})" for h in hosts) + ")"
SPACED = lambda c: f"regexp_replace(regexp_replace(lower({c}), '[^\\x00-\\x7F]+', '%AA', 'g'), '[._/-]+', ' ', 'g')"
LINK = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
#: a keyword counts unless an earlier one that holds it is there as well
KEPT = ", ".join("case when contains(plain, {0}){1} then {0} end".format(S.q(w), "".join(f" and not contains(plain, {S.q(e)})" for e in P.LINK_KEYWORDS[:i] if w in e)) for i, w in enumerate(P.LINK_KEYWORDS))
PARTS = f"""l as (select page_id, html, page_kind, replace(trim(url), '&amp;', '&') as u from r_links),
p0 as (select *, lower(regexp_extract(u, {S.q(LINK)}, 1)) as host, coalesce(nullif(regexp_extract(u, {S.q(LINK)}, 2), ''), '/') as path, regexp_extract(u, {S.q(LINK)}, 3) as qs, regexp_extract(u, {S.q(LINK)}, 4) as frag from l),
p1 as (select *, lower(url_decode(concat_ws(' ', host, path, qs, frag))) as plain, lower(concat_ws(' ', host, path)) as both_, list_filter(string_split(path, '/'), lambda x: x <> '') as steps, string_split(host, '.') as labels,
  {WORD(SPACED("concat_ws(' ', host, path)"), P.CAREER_WORDS)} as career,
  case {" ".join(f"when {UNDER(hosts)} then {S.q(company)}" for company, hosts in P.KNOWN_SITES)} end as site,
  path not in ('', '/') and not regexp_matches(lower(path), {S.q(V.LIST_PATH)}) and not (regexp_matches(lower(qs), {S.q(V.LIST_QUERY)}) and not regexp_matches(lower(qs), {S.q(V.ID_QUERY)}))
    and ({WORD("regexp_replace(url_decode(lower(path)), '[._/-]+', ' ', 'g')", "|".join(V.DETAIL_WORDS))} or regexp_matches(url_decode(path), {S.q("|".join(V.DETAIL_WORDS_CJK))})) as detail from p0),
p2 as (select *, list_filter([{KEPT}], lambda x: x is not null) as words, case when labels[1] in {S.words(P.GENERIC_LABELS)} and len(labels) > 1 then labels[2] else labels[1] end as own from p1),
c as (select *, case when regexp_matches(array_to_string(words, ' '), {S.q(P.CAMPUS_WORDS)}) then 'official_campus' when regexp_matches(array_to_string(words, ' '), {S.q(P.SOCIAL_WORDS)}) then 'official_social_recruiting' else 'official_company_career' end as kind,
  regexp_extract(qs, '[?&]for=([^&]*)', 1) as asked, len(steps) >= 3 and list_contains(steps, 'jobs') as one_job,
  (ends_with(host, '.cn') or contains(host, 'china') or regexp_matches(url_decode(path || qs), '[一-鿿]')) and detail as parsed,
  case when host = '' then 'invalid' when site is null and {UNDER(P.THIRD_PARTY_HOSTS)} then 'third_party' when site is null and {UNDER(P.ARTICLE_HOSTS)} then 'article'
   when site is null and ({UNDER(P.REPOST_HOSTS)} or ({UNDER(['edu.cn'])} and regexp_matches(lower(concat_ws(' ', host, url_decode(path))), {S.q(P.UNIVERSITY_WORDS)}))) then 'repost'
   when site is null and (regexp_matches(lower(path), {S.q(P.ARTICLE_PATH + '([^A-Za-z0-9_]|$)')}) or ({WORD("both_", P.SEO_SUBJECT)} and regexp_matches(both_, {S.q(P.SEO_WORDS)}))) then 'article'
   when {UNDER(['mokahr.com'])} then 'moka' when {UNDER(['italent.cn', 'zhiye.com'])} then 'beisen' when {UNDER(['feishu.cn', 'feishu-boe.cn', 'larksuite.com'])} and career then 'feishu_recruit'
   when site is not null then 'known' when host in ('job-boards.greenhouse.io', 'boards.greenhouse.io') or ends_with(host, '.greenhouse.io') then 'greenhouse' when host = 'jobs.lever.co' then 'lever'
   when contains(host, 'myworkdayjobs.com') then 'workday' when host = 'jobs.ashbyhq.com' then 'ashby' when ends_with(host, 'smartrecruiters.com') then 'smartrecruiters' when career then 'career' else 'unknown' end as cls from p2)"""
BLOCKED = "cls in ('third_party', 'article', 'repost', 'invalid')"
ATS = "cls in ('moka', 'beisen', 'feishu_recruit')"
OFFICIAL = "cls in ('greenhouse', 'lever', 'workday', 'ashby', 'smartrecruiters')"
PLATFORM = "case cls when 'third_party' then 'third_party_job_board' when 'article' then 'content_article' when 'repost' then 'campus_repost' when 'invalid' then 'unknown' when 'known' then 'official_careers' when 'career' then 'official_careers' else cls end"
GH_SLUG = "case when host in ('job-boards.greenhouse.io', 'boards.greenhouse.io') then coalesce(steps[1], nullif(asked, '')) else coalesce(nullif(asked, ''), steps[1]) end"
WHY = (f"case cls when 'beisen' then {S.q(P.REASONS['china_ats'])} when 'feishu_recruit' then {S.q(P.REASONS['china_ats'])} when 'greenhouse' then case when one_job then {S.q(P.REASONS['greenhouse_detail'])} else {S.q(P.REASONS['greenhouse'])} end"
       f" when 'lever' then case when len(steps) >= 2 then {S.q(P.REASONS['lever_detail'])} else {S.q(P.REASONS['lever'])} end when 'career' then case when parsed then {S.q(P.REASONS['career_detail'])} else {S.q(P.REASONS['career'])} end"
       + "".join(f" when {S.q(k)} then {S.q(P.REASONS[k])}" for k in ("invalid", "third_party", "article", "repost", "moka", "known", "workday", "ashby", "smartrecruiters", "unknown")) + " end")
LINK_FIELDS = f"""{PLATFORM} as platform, case when {BLOCKED} then 'unknown' when {ATS} then 'official_careers' else {PLATFORM} end as stored_platform,
  case when {ATS} or cls in ('known', 'career') then kind when {OFFICIAL} then 'official_ats' else {PLATFORM} end as source_type,
  case cls when 'invalid' then null when 'moka' then coalesce(steps[2], steps[1], own) when 'beisen' then coalesce(steps[1], own) when 'feishu_recruit' then coalesce(steps[1], own) when 'known' then site when 'greenhouse' then {GH_SLUG}
    when 'lever' then steps[1] when 'ashby' then steps[1] when 'smartrecruiters' then coalesce(steps[1], own) else own end as company,
  cast(case when {BLOCKED} then 0 when {ATS} then 0.82 when cls = 'known' then 0.85 when cls = 'greenhouse' then case when one_job then 0.95 else 0.85 end when cls = 'lever' then case when len(steps) >= 2 then 0.95 else 0.85 end
    when {OFFICIAL} then 0.75 when cls = 'career' then case when parsed then 0.72 else 0.65 end else 0.25 end as double) as confidence, {WHY} as reason,
  case when {ATS} then 'china_ats:' || cls when cls = 'known' then 'known_china_official_source' when {OFFICIAL} then 'official_ats:' || cls when cls = 'career' then 'career_keyword' end as signal,
  case when cls = 'invalid' then '' else array_to_string(words, ',') end as keywords, case when {BLOCKED} then {WHY} end as reject_reason,
  case when cls = 'moka' then 'moka' when cls = 'known' then case {" ".join(f"when host = {S.q(h)} and regexp_matches(path, {S.q(r)}) then {S.q(n)}" for n, h, r in P.OWN_PARSERS)} when detail then 'generic_official_detail' end
    when cls in ('greenhouse', 'lever') then cls when cls = 'career' and parsed then 'generic_official_detail' end as parser,
  case cls when 'moka' then coalesce(steps[2], steps[1], own) when 'beisen' then coalesce(steps[1], own) when 'feishu_recruit' then coalesce(steps[1], own) when 'greenhouse' then {GH_SLUG} when 'lever' then steps[1] when 'ashby' then steps[1] end as slug,
  {BLOCKED} as rejected"""
RECORD = f"not rejected and case when platform = 'unknown' then {WORD(SPACED(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', host, path)'), P.HIRING_WORDS)} else confidence >= 0.5 end"


@query("classify_links", f"with {PARTS}, f as (select *, {LINK_FIELDS} from c) select page_id, platform, stored_platform, source_type, company, confidence, reason, signal, keywords, reject_reason, parser, slug, rejected, {RECORD} as recorded from f")
def _(t):
    rows = t.links.select("page_id", "url", PG.classify_link("url").alias("f"))
    return rows.select("page_id", *["f." + c for c in ("platform", "stored_platform", "source_type", "company", "confidence", "reason", "signal")], F.array_join("f.keywords", ",").alias("keywords"),
                       "f.reject_reason", "f.parser", "f.slug", "f.rejected", PG.worth_recording("url", F.col("f")).alias("recorded"))


# pages as fetched: the stored body with what platforms, walls and script shells add to it
FETCHED = """select page_id, url, html_title, html || case page_id % 12 when 0 then '<script src="https://cdn.mokahr.com/x.js"></script>' when 1 then '<a href="https://acme.hotjob.cn/wt/board">jobs</a>'
  when 2 then ' var h = "acme.zhiye.com"; ' when 3 then '<script>fetch("/wday/cxs/acme/jobs")</script>' when 4 then '<form><input name=p type="password"><b>Log in</b></form>'
  when 5 then '<a href="/a/notice.pdf?x=1">NOTICE</a>' when 6 then '<div class=x id="app"></div>' when 7 then 'Access Denied' when 8 then '<a href="https://api.lever.co/v0/postings/acme">x</a> greenhouse.io'
  when 9 then '<p>招聘 职位列表</p><input type=password> sign in <i>job-detail</i>' else '' end as html,
  case when page_id % 17 = 0 then 403 else 200 end as status, case page_id % 4 when 0 then html_title || '有限公司' when 1 then 'Nobody Holdings Ltd' when 2 then '' else word || ' Group Inc' end as company
  from (select page_id, url, html, regexp_extract(html, '<title>([^<&]*)', 1) as html_title, regexp_extract(html, '<title>[A-Za-z]* ?([a-z]*)', 1) as word from r_links) as x"""


def _host_rule(host, path):
    out = []
    for token, platform, adapter in P.PLATFORM_HOSTS:
        fits = f"{host} = {S.q(token)} or ends_with({host}, {S.q('.' + token)})" if "." in token else f"list_contains(string_split({host}, '.'), {S.q(token)})"
        name = S.q(f"{platform} {adapter or ''}")
        out.append(f"when {fits} then " + (f"case when contains({path}, '/wt/') then 'wt wt' else {name} end" if platform == "hotjob" else name))
    return "case " + " ".join(out) + " end"


URL_IN = "(?i)https?://[^\\s\"''<>\\\\]+"
OF_URL = lambda k: f"lower(regexp_extract(regexp_replace(x, '[);,]+$', ''), {S.q(LINK)}, {k}))"
PAGE_PLATFORM = (f"coalesce({_host_rule('lower(regexp_extract(url, ' + S.q(LINK) + ', 1))', 'lower(regexp_extract(url, ' + S.q(LINK) + ', 2))')}, "
                 f"list_filter(list_transform(regexp_extract_all(html, '{URL_IN}'), lambda x: {_host_rule(OF_URL(1), OF_URL(2))}), lambda x: x is not null)[1], "
                 f"list_filter(list_transform(regexp_extract_all(lower(html), '(?:[a-z0-9-]+\\.)+[a-z]{{2,}}'), lambda x: {_host_rule('x', S.q(''))}), lambda x: x is not null)[1], "
                 "case " + " ".join(f"when contains(lower(url) || chr(10) || lower(html), {S.q(token)}) then {S.q(f'{p} {a}')}" for token, p, a in P.PLATFORM_INTERFACES) + " end, 'unknown ')")
SHAPE = f"regexp_matches(lower(html), {S.q(P.JOB_SHAPE)})"
PAGE_STATE = f"""case when status in (403, 412, 503) or contains(lower(html), 'access denied') or contains(lower(html), 'cloudflare challenge') or contains(lower(html), 'cf-chl-')
    or (contains(lower(html), 'akamai') and (contains(lower(html), 'challenge') or contains(lower(html), 'denied'))) or (contains(lower(html), '请开启javascript') and not contains(lower(html), '/api/')) then 'anti_bot'
  when regexp_matches(lower(html), '<input[^>]+type=["'']?password') and regexp_matches(lower(html), {S.q(P.LOGIN_WORDS)}) and not {SHAPE} then 'login_wall'
  when regexp_matches(lower(html), 'href=["''][^"'']+\\.pdf([?#][^"'']*)?["'']') and regexp_matches(lower(html), {S.q(P.NOTICE_WORDS)}) and not {SHAPE} then 'no_stable_jd'
  when regexp_matches(lower(html), '<div[^>]+id=["'']app["'']') or contains(lower(html), '__nuxt__') or contains(lower(html), '__next_data__') then 'unknown_spa' end"""
COMPACT = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
PLAIN = lambda c: f"replace(replace(replace(replace(replace({c}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&'), '&amp;', '&')"
VISIBLE = "regexp_replace(regexp_replace(html, '(?is)<(?:script|style|noscript)\\b[^>]*>.*?</(?:script|style|noscript)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"


@query("page_fingerprint", f"""with f as ({FETCHED}), g as (select *, {PAGE_PLATFORM} as p, {PAGE_STATE} as state, {COMPACT('company')} as full_,
    {COMPACT(PLAIN("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)"))} as head, {COMPACT(f"substr({PLAIN(VISIBLE)}, 1, {P.IDENTITY_CHARS})")} as body, translate(lower(regexp_extract(url, {S.q(LINK)}, 1)), '-.', '') as host,
    (select count(*) from (select unnest(regexp_extract_all({PLAIN(VISIBLE)}, '(?i)(招聘|社会招聘|校园招聘|职位|岗位|人才|加入我们|工作机会|\\b(?:careers?|jobs?|recruit(?:ment|ing)?|talent)\\b)')))) as words from f),
  h as (select *, regexp_replace(full_, '(.)(?:{"|".join(P.IDENTITY_SUFFIXES)})+$', '\\1') as core from g),
  k as (select *, case when full_ <> '' and (contains(head, full_) or contains(body, full_)) then 'full' when core <> full_ and (len(regexp_extract_all(core, '[一-鿿]')) >= 2 or (not regexp_matches(core, '[一-鿿]') and len(regexp_extract_all(core, '[a-z0-9]')) >= 3))
      and (contains(head, core) or contains(body, core)) then 'core' end as named from h)
  select page_id, string_split(p, ' ')[1] as platform, nullif(string_split(p, ' ')[2], '') as adapter, state, company = '' or named is not null as is_own,
    case when company = '' then 'company_not_provided' when named is null then 'page_company_not_found' else 'page_company_match:' || named || case when len(list_filter(regexp_extract_all(lower(company), '[a-z0-9]{{3,}}'), lambda w: contains(host, w))) > 0 then '+host_related' else '' end end as own_reason from k""")
def _(t):
    sql = FETCHED.replace("html || case", "concat(html, case").replace("else '' end as html,", "else '' end) as html,").replace("html_title || '有限公司'", "concat(html_title, '有限公司')").replace("word || ' Group Inc'", "concat(word, ' Group Inc')")
    rows = t.sql(sql.replace("from r_links", "from {r_links}"))
    p, own = PG.page_platform("url", "html"), PG.page_identity("company", "url", "html")
    rows = rows.select("page_id", p.alias("p"), PG.page_state("status", "html").alias("state"), own.alias("own"))
    return rows.select("page_id", "p.platform", "p.adapter", "state", F.col("own.ok").alias("is_own"), F.col("own.reason").alias("own_reason"))


from ..functions import career as CR, resume as RS  # noqa: E402
from ..operators import campus as CA, discovery as D, insights as IN  # noqa: E402
from .roles import NOW  # noqa: E402

STRIP = "'^[\\s \\x{3000}\\x{FEFF}]+|[\\s \\x{3000}\\x{FEFF}]+$'"
ORDERED = lambda c, terms: ("list_transform(list_sort(list_filter([" + ", ".join(f"{{'i': instr(lower({c}), {S.q(w.lower())}), 'l': {len(w)}, 'k': {i}, 't': {S.q(w)}}}" for i, w in enumerate(terms)) + "], lambda x: x.i > 0)), lambda x: x.t)")
LISTED = lambda pairs: "list_filter([" + ", ".join(f"case when {cond} then {S.q(label)} end" for label, cond in pairs) + "], lambda x: x is not null)"
ROLES_IN = lambda c: LISTED([(role, "(" + " or ".join(f"contains(lower({c}), {S.q(a.lower())})" for a in aliases) + ")") for role, aliases in RS.ROLES])
LINES_OF = lambda words: f"list_slice(list_transform(list_filter(ls, lambda x: regexp_matches(x, {S.q(words)})), lambda x: substr(x, 1, {RS.LINE_CHARS})), 1, {RS.LINES})"
FIRST_LINE = lambda words: f"list_filter(ls, lambda x: regexp_matches(x, {S.q(words)}))[1]"


@query("resume_profiles", f"""with a as (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(translate(text, chr(13) || chr(9), chr(10) || ' '), ' {{2,}}', ' ', 'g'), '\\n+'), lambda x: regexp_replace(x, {STRIP}, '', 'g')), lambda x: x <> '') as ls from r_resumes),
  b as (select *, array_to_string(ls, chr(10)) as plain, substr(coalesce(regexp_replace(regexp_replace({FIRST_LINE(RS.INTENT)}, {S.q(RS.INTENT_LABEL)}, ''), {STRIP}, '', 'g'), {FIRST_LINE(RS.MEANINGFUL)}, ls[1], {S.q(RS.NO_HEADLINE)}), 1, {RS.HEADLINE_CHARS}) as headline from a),
  c as (select *, case when len({ROLES_IN('headline')}) > 0 then {ROLES_IN('headline')} else {ROLES_IN('plain')} end as roles, {ORDERED('plain', RS.CITIES)} as cities, array_to_string(list_filter(ls, lambda x: regexp_matches(x, {S.q(RS.SKILL_LINE)})), chr(10)) as told,
    {LINES_OF(RS.EDUCATION_LINE)} as edu, {LINES_OF(RS.EXPERIENCE_LINE)} as exp from b),
  d as (select *, {ORDERED('told', RS.SKILLS)} as named, {ORDERED('plain', RS.SKILLS)} as every from c),
  e as (select *, list_concat(named, list_filter(every, lambda s: not (list_contains(roles, '数据分析') and s = '数据分析') and not list_contains(named, s))) as skills from d)
  select doc_id, headline, array_to_string(roles, ',') as roles, array_to_string(cities, ',') as cities, array_to_string(skills, ',') as skills, array_to_string({LISTED([(n, f"regexp_matches(plain, {S.q(p)})") for n, p in RS.INDUSTRIES])}, ',') as industries,
    case {" ".join(f"when regexp_matches(plain, {S.q(p)}) then {S.q(n)}" for n, p in RS.STAGES)} else {S.q(RS.NO_STAGE)} end as stage, array_to_string(edu, '|') as education, array_to_string(exp, '|') as experience,
    substr(array_to_string(edu, '；'), 1, {RS.SUMMARY_CHARS}) as education_summary, substr(array_to_string(exp, '；'), 1, {RS.SUMMARY_CHARS}) as experience_summary,
    concat_ws('；', nullif(headline, ''), case when len(roles) > 0 then '方向：' || array_to_string(roles, '、') end, case when len(cities) > 0 then '城市：' || array_to_string(cities, '、') end, case when len(skills) > 0 then '技能：' || array_to_string(skills[1:{RS.SUMMARY_SKILLS}], '、') end) as summary,
    array_to_string(skills[1:{RS.PREFERRED['skills']}], ',') as keywords, array_to_string(cities[1:{RS.PREFERRED['target_locations']}], ',') as wanted_cities, array_to_string(skills[1:{RS.ENGLISH_ITEMS}], ',') as en_skills from e""")
def _(t):
    rows = t.resumes.select("doc_id", RS.parse_resume("text").alias("p"))
    rows = rows.select("doc_id", "p", RS.preferences("p").alias("w"), RS.english_profile("p").alias("en"))
    joined = lambda c, name, sep=",": F.array_join(c, sep).alias(name)
    return rows.select("doc_id", "p.headline", joined("p.target_roles", "roles"), joined("p.target_locations", "cities"), joined("p.skills", "skills"), joined("p.industries", "industries"), "p.stage", joined("p.education", "education", "|"),
                       joined("p.experience", "experience", "|"), "p.education_summary", "p.experience_summary", "p.summary", joined("w.target_keywords", "keywords"), joined("w.target_locations", "wanted_cities"), joined("en.en_skills", "en_skills"))


def listed_companies(t):
    """Companies of the list with their industry and open postings."""
    open_posts = t.posts.where("status = 'active'").groupBy(F.col("source_id").alias("pos")).agg(F.count("*").alias("job_count"))
    return t.list.select("pos", "industry", (F.col("pos") % 50).cast("string").alias("company"), F.col("name").alias("display_name")).join(open_posts, "pos", "left")


def wanted_companies(t):
    """Companies a user looks at: those of the list in the industry of the user's preferences."""
    return t.prefs.select("user_id", "industry").join(listed_companies(t), "industry").drop("industry")


def company_items(t):
    return t.sql("select cast(company_id as string) as company, dimension, pos, time_window, title, content from {r_items}")


NORM = "translate(coalesce(time_window, ''), '–—－~〜到至', '-------')"
SPANS = f"list_filter(list_transform(regexp_extract_all({NORM}, '(\\d{{1,2}})\\s*-\\s*(\\d{{1,2}})\\s*月'), lambda x: [regexp_extract(x, '(\\d+)', 1)::int, regexp_extract(x, '-\\s*(\\d+)', 1)::int]), lambda r: r[1] between 1 and 12 and r[2] between 1 and 12)"
SINGLE = f"list_filter(list_transform(regexp_extract_all(regexp_replace({NORM}, '\\d{{1,2}}\\s*-\\s*\\d{{1,2}}\\s*月', ' ', 'g'), '(\\d{{1,2}})\\s*月', 1), lambda x: x::int), lambda m: m between 1 and 12)"
MONTHS_OF = f"list_sort(list_distinct(list_concat(flatten(list_transform({SPANS}, lambda r: range(least(r[1], r[2]), greatest(r[1], r[2]) + 1))), {SINGLE})))"
JUDGED = f"""w as (select *, {MONTHS_OF} as months, regexp_matches(coalesce(time_window, ''), {S.q(CR.ROLLING)}) as rolling, regexp_matches(coalesce(time_window, ''), {S.q(CR.ADVERSE)}) as negative from r_items),
  j as (select *, case when len(months) > 0 then case when negative then case when list_contains(months, 8) then 'closed' else 'unknown' end when list_contains(months, 8) then 'open' else 'closed' end when rolling then 'rolling' else 'unknown' end as state from w)"""


@query("window_months", f"with {JUDGED} select pos, array_to_string(months, ',') as months, rolling, negative, state as status from j")
def _(t):
    w = CR.window_months("time_window")
    return company_items(t).select("pos", w.alias("w"), CR.window_status("time_window", 8).alias("status")).select("pos", F.array_join("w.months", ",").alias("months"), "w.rolling", "w.negative", "status")


NOTE = "coalesce(nullif(trim(coalesce(title, '')), ''), case when length(trim(content)) > 48 then substr(trim(content), 1, 48) || '…' else nullif(trim(content), '') end)"
STATE_RANK = "case state when 'open' then 3 when 'rolling' then 2 when 'closed' then 1 else 0 end"


@query("career_path", f"""with {JUDGED}, b as (select company_id, arg_max(struct_pack(s := state, w := time_window), ({STATE_RANK}, -pos)) as t from j where dimension = 'timing' group by company_id),
  n as (select company_id, arg_min(struct_pack(n := {NOTE}), pos) filter (where dimension = 'compensation_intensity') as pay, arg_min(struct_pack(n := {NOTE}), pos) filter (where dimension = 'culture') as care from r_items group by company_id),
  o as (select source_id as pos, count(*) as job_count from r_posts where status = 'active' group by 1),
  m as (select user_id, l.pos, l.pos % 50 as company_id, l.name as display_name, coalesce(o.job_count, 0) as job_count from r_prefs p join r_list l on p.industry = l.industry left join o on o.pos = l.pos),
  r as (select m.*, coalesce(b.t.s, 'unknown') as status, b.t.w as detail, n.pay.n as comp_note, n.care.n as caution_note from m left join b using (company_id) left join n using (company_id))
  select user_id, pos, display_name, status, detail, job_count, comp_note, caution_note, case status when 'open' then '招聘窗口期' when 'rolling' then '全年滚动' when 'closed' then '可能非窗口期' else '时机未知' end as label,
    concat_ws('|', case status when 'open' then '招聘窗口期' when 'rolling' then '全年滚动' when 'closed' then '可能非窗口期' else '时机未知' end, case when job_count > 0 then job_count || ' 个在招岗位' end, case when caution_note is not null then '有温馨提示' end) as reasons,
    row_number() over (partition by user_id order by case status when 'open' then 3 when 'rolling' then 2 when 'unknown' then 1 else 0 end desc, job_count desc, pos) as rank from r""")
def _(t):
    p = IN.career_path(t.prefs.select("user_id", "industry"), company_items(t), NOW, listed_companies(t), "industry")
    return p.select("user_id", "pos", "display_name", "status", "detail", "job_count", "comp_note", "caution_note", "label", F.array_join("reasons", "|").alias("reasons"), F.col("rank").cast("long").alias("rank"))


@query("career_notes", """select p.user_id, case i.dimension when 'path' then 'path_note' else 'caution' end as kind, l.pos, i.pos as item_pos, l.name as company, i.title, i.content
  from r_prefs p join r_list l on p.industry = l.industry join r_items i on i.company_id = l.pos % 50 where i.dimension in ('path', 'culture')""")
def _(t):
    return IN.career_notes(wanted_companies(t), company_items(t))


@query("career_header", """select c.user_id, c.role <> '' or c.city <> '' or c.stage <> '' as has_profile, coalesce(n, 0) as recommendations, case when coalesce(n, 0) = 0 then case when c.role <> '' or c.city <> '' or c.stage <> '' then 'insight_unverified' else 'no_profile' end end as failure_reason
  from r_prefs c left join (select user_id, count(*) as n from r_prefs p join r_list l on p.industry = l.industry where p.user_id % 3 <> 0 group by 1) using (user_id)""")
def _(t):
    profiles = t.prefs.select("user_id", F.array("role").alias("target_roles"), F.col("stage").alias("seniority"), F.array("city").alias("target_locations"))
    return IN.career_header(profiles, wanted_companies(t).where("user_id % 3 <> 0"))


LIST_PROFILES = "select cast(s_suppkey as int) as pos, s_suppkey % 50 as profile_id, case s_suppkey % 3 when 0 then concat('Brand', cast(s_suppkey as string), ' Inc.') when 1 then concat('甲', 'brand', cast(s_suppkey as string)) else 'x' end as name, concat('BRAND ', cast(s_suppkey + 1 as string)) as alias from {supplier}"


@query("cycles_for", f"""with p as ({LIST_PROFILES.replace('{supplier}', 'supplier')}), k as (select profile_id, lower(unnest([regexp_replace(name, ' Inc\\.$', ''), replace(alias, ' ', '')])) as key from p), n as (select distinct pattern, lower(name) as q from r_list),
  o as (select distinct pattern, profile_id from n join k on q = key or (contains(q, key) and length(key) >= 5) or (contains(key, q) and length(q) >= 5))
  select pattern, id, season, batch, event, month_start, month_end, valid_until from o join r_claims on profile_id = company_id where verify_status = 'verified' and valid_until >= date '1998-08-02'""")
def _(t):
    profiles = t.sql(LIST_PROFILES).select("pos", "profile_id", "name", F.array("alias").alias("aliases"))
    return CA.cycles_for(t.list, t.claims, profiles, "1998-08-02 00:00:00").select("pattern", "id", "season", "batch", "event", "month_start", "month_end", "valid_until")


def diagnostics(t):
    """Query diagnostics with their results, from links dealt to queries."""
    results = t.results.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "url", "title", "snippet"))), lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"), r["snippet"].alias("snippet"))).alias("results"))
    return t.diags.join(results.withColumnRenamed("q", "pos"), "pos")


def search_runs(t):
    """Runs with their providers as JSON; the first query of a provider stands in its own row where it is the only one."""
    d = diagnostics(t)
    one = F.struct(F.col("pos"), F.struct("query", F.lit("").alias("provider_name"), "results").alias("d"))
    p = d.groupBy("run_id", "provider").agg(F.array_sort(F.collect_list(one)).alias("qs"))
    told = F.when(F.size("qs") > 1, F.struct(F.transform("qs", lambda q: q["d"]).alias("queries")))
    p = p.select("run_id", F.struct(F.col("provider").alias("name"), F.get("qs", F.lit(0))["d"]["query"].alias("query"), told.alias("diagnostics"), F.when(F.size("qs") == 1, F.get("qs", F.lit(0))["d"]["results"]).alias("results")).alias("p"))
    return p.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list("p"), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))).alias("providers"))


AUDIT = f"""{PARTS.replace('from r_links', "from (select r.page_id, r.url, '' as html, 0 as page_kind from r_results r)", 1)}, f as (select *, {LINK_FIELDS} from c),
  a as (select r.run_id, r.provider, r.q, r.n, r.page_id, r.title, r.url, r.snippet, f.* exclude (page_id) from (select *, row_number() over (partition by q order by n) rn from r_results) r join f on f.page_id = r.page_id where rn <= 10)"""


@query("results_audit", f"with {AUDIT} select run_id, provider as provider_name, 'q' || q as query, title, url, snippet, source_type as classification, platform as detected_platform, reject_reason, signal as official_signal, confidence from a")
def _(t):
    a = D.results_audit(search_runs(t))
    return a.select("run_id", "provider_name", "query", "title", "url", "snippet", F.col("found.source_type").alias("classification"), F.col("found.platform").alias("detected_platform"), "found.reject_reason", F.col("found.signal").alias("official_signal"), "found.confidence")


@query("candidate_rows", f"""with {AUDIT} select run_id, 'q' || q as query, coalesce(company, 'none') as company, title, url, source_type, stored_platform as detected_platform, confidence, 'pending' as status,
  json_extract_string(j, '$.company_guess') as guess, cast(j as varchar) as reason from (select *, to_json({{'provider_name': provider, 'provider_query': 'q' || q, 'title': title, 'snippet': nullif(snippet, ''), 'query': 'q' || q, 'url': url, 'company_guess': coalesce(company, 'none'),
    'source_type': source_type, 'detected_platform': platform, 'db_detected_platform': stored_platform, 'confidence': confidence, 'status': 'pending', 'reason': reason, 'matched_keywords': case when cls = 'invalid' then [] else words end, 'official_signal': signal, 'reject_reason': reject_reason,
    'parser_supported': parser is not null, 'parser_name': parser}}) as j from a where not rejected)""")
def _(t):
    a = D.results_audit(search_runs(t)).where("not found.rejected")
    return D.candidate_rows(a, "pending", "none").withColumn("guess", F.get_json_object("reason", "$.company_guess"))


@query("candidate_status", """select page_id, case page_id % 4 when 0 then '{"a":1,"b":["x",null],"status":"parsed","status_update":"ok ' || page_id || '","status_updated_at":"2024-01-31"}'
    when 1 then '{"previous_reason":"plain \\"words\\" ' || page_id || '","status":"parsed","status_update":"ok ' || page_id || '","status_updated_at":"2024-01-31"}'
    when 2 then '{"previous_reason":"[1, 2]","status":"parsed","status_update":"ok ' || page_id || '","status_updated_at":"2024-01-31"}' else '{"status":"parsed","status_update":"ok ' || page_id || '","status_updated_at":"2024-01-31"}' end as reason from pages""")
def _(t):
    old = F.expr("""case page_id % 4 when 0 then '{"a": 1, "status": "pending", "b": ["x", null]}' when 1 then concat('plain "words" ', page_id) when 2 then '[1, 2]' end""")
    return t.pages.select("page_id", D.merged_reason(old, "parsed", F.concat(F.lit("ok "), F.col("page_id")), "2024-01-31").alias("reason"))


LIMITED = "(rate_limited or coalesce(http_status = 429, false) or regexp_matches(coalesce(error, ''), '(?i)429|rate\\s*limit|too many requests'))"


@query("provider_summary", f"""with g as (select run_id, provider, sum(raw_results_count)::bigint as raw_results, sum(extracted_urls_count)::bigint as extracted_urls, count(*) filter (status = 'provider_failed') as failed, bool_or({LIMITED}) as rate_limited,
    arg_min(struct_pack(c := http_status), pos) filter ({LIMITED}) as l, arg_min(http_status, pos) filter (http_status is not null) as h, string_agg(query, ' | ' order by pos) as query from r_diags group by run_id, provider),
  e as (select run_id, provider, string_agg(error, chr(10) order by p) as error from (select run_id, provider, error, min(pos) as p from r_diags where error <> '' group by all) group by run_id, provider),
  u as (select run_id, provider, count(distinct url) as links from r_results where url <> '' group by run_id, provider)
  select g.run_id, g.provider, query, case when extracted_urls > 0 then case when failed > 0 then 'partial_success' else 'success' end when failed > 0 then 'provider_failed' else 'no_results_found' end as status,
    coalesce(nullif(l.c, 0), nullif(h, 0)) as http_status, raw_results, extracted_urls, error, rate_limited, coalesce(links, 0) as links from g left join e using (run_id, provider) left join u using (run_id, provider)""")
def _(t):
    return D.provider_summary(diagnostics(t))


@query("provider_links", "select run_id, provider, url, title, snippet, 'q' || q as query from (select *, row_number() over (partition by run_id, provider, url order by q, n) rn from r_results where url <> '') where rn = 1")
def _(t):
    return D.provider_links(diagnostics(t))


STATUS_RUNS = """select id, case when id % 9 = 0 then ' ' when id % 9 = 1 then 'queued' when id % 9 = 2 then 'running' else status end as status, jobs_created, jobs_updated, case when id % 4 = 0 then null else jobs_found end as candidates_found,
  case when id % 6 = 0 then 'no_results' else '' end as failure_reason, error_message, started_at, created_at, finished_at,
  case id % 5 when 0 then concat('{{"produced_jd_urls":["https://a/', cast(id as string), '",7,"",null,{{"u":1}},"https://b"]}}') when 1 then '{{"produced_jd_urls":"x"}}' when 2 then 'broken {{' when 3 then null else '{{"other":[1]}}' end as diagnostics from {r_runs}"""


@query("run_status", """with r as (""" + STATUS_RUNS.replace("{r_runs}", "r_runs").replace("{{", "{").replace("}}", "}") + """), s as (select *, coalesce(nullif(trim(status), ''), 'unknown') as st from r)
  select id, st as status, case st when 'queued' then 'queued' when 'running' then 'running' when 'success' then 'done' when 'partial_success' then 'done' when 'failed' then 'failed' when 'skipped' then 'failed' else 'unknown' end as phase, st in ('success', 'partial_success', 'failed', 'skipped') as is_terminal,
    jobs_created, jobs_updated, coalesce(candidates_found, 0) as candidates_found, nullif(failure_reason, '') as failure_reason, nullif(trim(error_message), '') as error_message, cast(coalesce(started_at, created_at) as timestamp) as started_at, cast(finished_at as timestamp) as finished_at,
    case id % 5 when 0 then 'https://a/' || id || ',https://b' else '' end as produced_urls from s""")
def _(t):
    return D.run_status(t.sql(STATUS_RUNS)).withColumn("produced_urls", F.array_join("produced_urls", ","))


OUTCOME_RUNS = """select id, id % 7 as total_urls, case when id % 7 = 0 then 0 else id % 5 end as candidates_found, id % 3 as candidates_parsed, case when id % 2 = 0 then id % 5 else 0 end as candidates_pending, case when id % 11 = 0 then 1 else 0 end as candidates_failed,
  case id % 4 when 0 then 0 when 1 then null else 2 end as parser_supported, case when id % 13 = 0 then 2 else 0 end as gate_failures, case when id % 6 = 0 then 1 else 0 end as jobs_created, case when id % 10 = 0 then 3 else 0 end as jobs_updated from {r_runs}"""
OUTCOME_PROVIDERS = "select id as run_id, case when id % 3 = 0 then 'provider_failed' else 'success' end as status, cast(case when id % 17 = 0 then 429 else 200 end as int) as http_status, case id % 19 when 0 then 'Search disabled' when 1 then 'Too Many Requests' else null end as error, id % 23 = 0 as rate_limited, id % 29 = 0 as disabled from {r_runs} where id % 5 <> 4"
ERRORS_OF = "case id % 8 when 0 then 'first' || chr(10) || 'second' when 1 then 'only' end"


@query("discovery_outcome", f"""with r as ({OUTCOME_RUNS.replace('{r_runs}', 'r_runs')}), p as ({OUTCOME_PROVIDERS.replace('{r_runs}', 'r_runs')}),
  g as (select run_id, bool_or(status = 'provider_failed') as f, bool_or(rate_limited or http_status = 429 or regexp_matches(coalesce(error, ''), '(?i)429|too many requests')) as l, bool_or(disabled or regexp_matches(coalesce(error, ''), '(?i)disabled')) as d from p group by run_id),
  x as (select r.*, coalesce(f, false) as f, coalesce(l, false) as l, coalesce(d, false) as d, {ERRORS_OF} as e, candidates_failed > 0 or gate_failures > 0 as bad, jobs_created > 0 or jobs_updated > 0 as w from r left join g on g.run_id = r.id),
  k as (select *, case when w then 'written' when l then 'provider_rate_limited' when d then 'provider_disabled' when f and total_urls = 0 then 'provider_failed' when total_urls = 0 then 'provider_no_results' when candidates_found = 0 then 'all_results_rejected' when bad then 'gate'
     when candidates_pending = candidates_found and parser_supported = 0 then 'parser_missing' when candidates_pending = candidates_found then 'candidates_pending' when candidates_parsed = 0 then 'no_detail' else 'rest' end as k from x)
  select id, case k when 'written' then case when f or bad then 'partial_success' else 'success' end when 'rest' then case when f then 'partial_success' else 'success' end when 'gate' then 'partial_success' when 'parser_missing' then 'partial_success' when 'candidates_pending' then 'partial_success' when 'no_detail' then 'partial_success' else 'failed' end as status,
    case k when 'written' then case when bad then 'quality_gate_failed' when l then 'provider_rate_limited' when f then 'provider_failed' end when 'rest' then case when f then 'provider_failed' end when 'gate' then 'quality_gate_failed' when 'no_detail' then 'quality_gate_failed' else k end as failure_reason,
    case when k in ('written', 'rest') then e when k in ('provider_no_results', 'all_results_rejected', 'parser_missing', 'candidates_pending') then {"case k " + " ".join(f"when {S.q(k)} then {S.q(v)}" for k, v in D.MESSAGES.items()) + " end"}
      else coalesce(e, {"case k " + " ".join(f"when {S.q(k)} then {S.q(v)}" for k, v in D.MESSAGES.items()) + " end"}) end as error_message from k""")
def _(t):
    errors = F.expr("case id % 8 when 0 then array('first', '', null, 'second') when 1 then array('only') end")
    return D.discovery_outcome(t.sql(OUTCOME_RUNS).withColumn("errors", errors), t.sql(OUTCOME_PROVIDERS))


@query("cached_outcome", """with c as (select id % 500 as id, count(*) as n, count(*) filter (id % 3 = 0) as parsed, count(*) filter (id % 3 = 1) as pending, count(*) filter (id % 3 = 2 and id % 4 <> 0) as failed from r_runs where id % 500 % 3 <> 0 group by 1),
  j as (select id % 700 as id, count(*) as n from r_runs where id % 700 % 2 = 0 group by 1)
  select r.id, case when coalesce(j.n, 0) > 0 then 'success' else status end as status, coalesce(c.n, 0) as candidates_found, coalesce(parsed, 0) as candidates_parsed, coalesce(pending, 0) as candidates_pending, coalesce(failed, 0) as candidates_failed, coalesce(j.n, 0) as jobs_reused,
    case when coalesce(j.n, 0) > 0 then null when coalesce(c.n, 0) > 0 then case when failed > 0 and pending = 0 then 'quality_gate_failed' else 'candidates_pending' end else 'provider_no_results' end as failure_reason, case when coalesce(j.n, 0) = 0 then error_message end as error_message
  from r_runs r left join c on c.id = r.id left join j on j.id = r.id""")
def _(t):
    c = t.runs.where("id % 500 % 3 <> 0").select((F.col("id") % 500).alias("run_id"), F.expr("case when id % 3 = 0 then 'parsed' when id % 3 = 1 then 'pending' when id % 4 <> 0 then 'failed' else 'other' end").alias("status"))
    return D.cached_outcome(t.runs, c, t.runs.where("id % 700 % 2 = 0").select((F.col("id") % 700).alias("run_id")))


PROPOSED = """select c_custkey % 7 as batch, c_custkey as pos, case c_custkey % 6 when 0 then concat(' Brand', cast(c_custkey % 60 as string), ' ') when 1 then concat('brand', cast(c_custkey % 40 as string), ' （中国）') when 2 then '' when 3 then concat('Newco', cast(c_custkey % 90 as string))
  when 4 then concat('newco', cast(c_custkey % 90 as string), '有限公司') else c_name end as company, case c_custkey % 3 when 0 then '' else concat('名', cast(c_custkey % 9 as string)) end as cn, c_custkey % 5 as slug_kind, c_mktsegment as industry from {customer}"""
FOLDED = lambda c: f"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[（(][^（）()]*[）)]', '', 'g'), '\\s+', '', 'g'), '(.)(?:{'|'.join(V.TARGET_SUFFIXES)})+$', '\\1')"
ATTRIBUTED = lambda n, w: f"(contains({n}, {w}) and (starts_with({n}, {w}) or regexp_matches(substr({n}, 1, instr({n}, {w}) - 1), {S.q('^(?:' + '|'.join(V.PLACE_PREFIXES) + ')?(?:' + '|'.join(V.PLACE_PREFIX_SUFFIXES) + ')?$')})))"


@query("clean_targets", f"""with r as ({PROPOSED.replace('{customer}', 'customer')}), s as (select *, trim(company) as name, {FOLDED('company')} as k from r where trim(company) <> '' and slug_kind not in (0, 1)),
  x as (select distinct s_name as e, {FOLDED('s_name')} as ek from supplier union select 'Brand3', 'brand3' union select '北京newco7', '北京newco7'),
  c as (select distinct s.name from (select distinct name, k from s) s join x on s.name = e or (k <> '' and k = ek) or {ATTRIBUTED('e', 's.name')} or (k <> '' and {ATTRIBUTED('ek', 'k')})),
  f as (select *, row_number() over (partition by batch, case when k <> '' then 'k:' || k else 'n:' || name end order by pos) rn from s where name not in (select name from c))
  select batch, pos, name as company, trim(coalesce(nullif(cn, ''), name)) as cn, case slug_kind when 2 then 'a' || pos else 's1,s2,s3,s4' end as slugs, industry from f where rn = 1""")
def _(t):
    slugs = F.expr("case slug_kind when 0 then array('two words', ' ') when 1 then null when 2 then array(concat(' a', pos, ' ')) else array('s1', 's2', 'x y', 's3', 's4', 's5') end")
    known = t.supplier.select(F.col("s_name").alias("company")).union(t.spark.createDataFrame([("Brand3",), ("北京newco7",)], "company string"))
    return D.clean_targets(t.sql(PROPOSED).withColumn("slugs", slugs), known).withColumn("slugs", F.array_join("slugs", ","))


# fixed values: public addresses of boards by platform
BOARD_TEMPLATES = [("greenhouse", "https://boards-api.greenhouse.io/v1/boards/{slug}/jobs?content=true"), ("lever", "https://api.lever.co/v0/postings/{slug}?mode=json"),
                   ("ashby", "https://api.ashbyhq.com/posting-api/job-board/{slug}?includeCompensation=true"), ("smartrecruiters", "https://api.smartrecruiters.com/v1/companies/{slug}/postings?limit=100")]


@query("expand_candidates", f"""with p as (select distinct on (name) name, pattern from r_list order by name, pos), t as (select c_custkey as pos, case when c_custkey % 3 = 0 then 'Brand' || (c_custkey % 200) else c_name end as company, c_custkey % 50 as s, c_mktsegment as industry from customer),
  k as (select t.*, lower(trim(replace(coalesce(pattern, company), '%', ''))) as token from t left join p on p.name = t.company), left_ as (select * from k where not exists (select 1 from supplier where s_suppkey % 2 = 0 and contains(lower(s_name), token))),
  w as (select pos, company, industry, unnest([1, 2, 3]) as ap, unnest(['lever', 'nowhere', 'greenhouse']) as adapter, s from left_), v as (select *, unnest([1, 2]) as sp, unnest(['c' || s, 'd' || s]) as slug from w),
  u as (select v.*, replace(template, '{{slug}}', slug) as url from v join (values {", ".join(f"({S.q(a)}, {S.q(x.replace('{', '{{').replace('}', '}}'))})" for a, x in BOARD_TEMPLATES)}) as m(adapter, template) on m.adapter = v.adapter)
  select url, company, adapter, industry, 'foreign' as segment from (select *, row_number() over (partition by url order by pos, ap, sp) rn from u) where rn = 1""".replace("{{", "{").replace("}}", "}"))
def _(t):
    targets = t.customer.select(F.col("c_custkey").alias("pos"), F.expr("case when c_custkey % 3 = 0 then concat('Brand', c_custkey % 200) else c_name end").alias("company"), F.expr("array(concat('c', c_custkey % 50), concat('d', c_custkey % 50))").alias("slugs"),
                                F.array(F.lit("lever"), F.lit("nowhere"), F.lit("greenhouse")).alias("ats"), F.col("c_mktsegment").alias("industry"))
    templates = t.spark.createDataFrame(BOARD_TEMPLATES, "adapter string, template string")
    return D.expand_candidates(targets, templates, t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("company")), t.list)


from ..functions import facts as FA  # noqa: E402

CITY_OF = "case when company_id % 7 = 3 then null else 'city' || (500 + company_id % 7) end"
FACTS_SQL = f"""with f as (select company_id, 'Q' || company_id as qid, case when company_id % 3 = 0 then '公司' || company_id else s_name end as label, company_id % 4 <> 3 as listed, case when company_id % 5 <> 0 then 'T' || company_id end as ticker,
  cast(case company_id % 3 when 0 then 2001 when 1 then 1987 end as int) as founded_year, case when company_id % 2 = 0 then company_id * 100 + 1 end as employees, {CITY_OF} as hq, case company_id % 4 when 0 then ['纽交所', '纳斯达克'] when 1 then ['甲所'] else [] end as ex from r_register),
  g as (select *, case when employees <= 0 then null when employees < 100 then '1-100' when employees < 500 then '100-500' when employees < 1000 then '500-1000' when employees < 5000 then '1000-5000' when employees < 10000 then '5000-1万' when employees < 50000 then '1万-5万' when employees < 100000 then '5万-10万' when employees is not null then '10万+' end as headcount_band from f)"""


def facts(t):
    labels = t.spark.createDataFrame([("Q999", "甲所"), ("Q1", "")] + [(f"Q{500 + k}", f"city{500 + k}") for k in range(7) if k != 3], "qid string, label string")
    return IN.company_facts(t.register.select("company_id", "entity"), labels)


@query("company_facts", FACTS_SQL + " select company_id, qid, label, listed, ticker, founded_year, employees, headcount_band, hq, array_to_string(ex, ',') as exchanges from g")
def _(t):
    return facts(t).select("company_id", "qid", "label", "listed", "ticker", "founded_year", "employees", "headcount_band", "hq", F.array_join("exchanges", ",").alias("exchanges"))


@query("listing_rows", FACTS_SQL + """ select company_id, case when listed or founded_year is not null then case when listed then '据 Wikidata 公开资料，' || label || ' 为已上市公司，挂牌于' || case when len(ex) > 0 then array_to_string(ex, '、') else '公开市场' end
    || case when ticker is not null and len(ex) > 0 then '（' || array_to_string(ex, '/') || ' ' || ticker || '）' when ticker is not null then '（代码 ' || ticker || '）' else '' end || '。' else '据 Wikidata 公开资料，' || label || ' 当前未见公开上市记录（未上市 / 未在主要交易所挂牌）。' end end as content,
  case when listed then 'listed' when founded_year is not null then 'private' end as status, case when listed then nullif(array_to_string(ex, '/'), '') end as exchange, case when listed or founded_year is not null then ticker end as ticker, founded_year, headcount_band, hq as hq_location, case when listed then '已上市' else '未上市/未披露' end as funding_stage from g""")
def _(t):
    return IN.listing_rows(facts(t)).select("company_id", "listing.content", "listing.status", "listing.exchange", "listing.ticker", "profile.founded_year", "profile.headcount_band", "profile.hq_location", "profile.funding_stage")


@query("filing_listing", """select company_id, case when company_id % 5 <> 0 then '据 SEC EDGAR 官方披露，' || s_name || ' 在美国证监会持续申报，最新申报 ' || case when company_id % 9 >= 5 then '8-K（2024-01-0' || company_id % 9 else '10-K（2024-01-05' end || '），挂牌于 NYSE/Nasdaq（代码 ' || case when company_id % 4 = 0 then 'AB' else 'T' || company_id end || '）。' end as content,
  case when company_id % 5 <> 0 then 'NYSE/Nasdaq' end as exchange, case when company_id % 5 <> 0 then case when company_id % 4 = 0 then 'AB' else 'T' || company_id end end as ticker, case when company_id % 5 <> 0 then case when company_id % 9 >= 5 then '8-K' else '10-K' end end as latest_form,
  case when company_id % 5 <> 0 then case when company_id % 9 >= 5 then '2024-01-0' || company_id % 9 else '2024-01-05' end end as latest_filing_date, case when company_id % 5 <> 0 then case when company_id % 3 = 0 then 'https://www.sec.gov/files/company_tickers.json'
  else 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || company_id || '&type=&dateb=&owner=include&count=40' end end as source_url from r_register""")
def _(t):
    f = t.register.select("company_id", FA.filing_listing("submissions", "ticker").alias("l"))
    return f.select("company_id", "l.content", "l.exchange", "l.ticker", "l.latest_form", "l.latest_filing_date", "l.source_url")


@query("reported_figures", """with f as (select company_id, cast(case when company_id % 6 = 0 then company_id * 9 + 100 else company_id * 7 + 100 end as double) as revenue, cast(case when company_id % 6 = 0 then company_id * 7 + 100 else company_id * 5 + 50.5 end as double) as before_ from r_register)
  select company_id, case when company_id % 6 = 0 then 2022 else 2021 end as fy, revenue, cast(case when company_id % 3 = 0 then -company_id end as double) as net_income, cast(round_even((revenue - before_) / abs(before_) * 100, 0) as bigint) as revenue_yoy_pct, company_id + 30 as employees from f""")
def _(t):
    return t.register.select("company_id", FA.reported_figures("report").alias("r")).select("company_id", "r.*")


STOCKS = "select cast(s_suppkey as int) as pos, concat(case s_suppkey % 6 when 0 then '60' when 1 then '00' when 2 then '83' when 3 then '92' when 4 then '11' else '' end, case when s_suppkey % 6 = 5 then '' else cast(s_suppkey as string) end) as code, concat(s_name, case when s_suppkey % 3 = 0 then '股份有限公司' when s_suppkey % 3 = 1 then '集团' else '' end) as zwjc, concat('o', cast(s_suppkey as string)) as orgId from {supplier}"


@query("find_stock", f"""with s as ({STOCKS.replace('{supplier}', 'supplier')}), n as (select s_suppkey, s_name || case when s_suppkey % 2 = 0 then '有限公司' else '' end as company from supplier),
  x as (select n.company, s.*, case substr(code, 1, 2) when '60' then '上交所' when '00' then '深交所' when '92' then '北交所' else case when code <> '' and substr(code, 1, 1) in ('8', '4') then '北交所' else 'A股' end end as m from n join s on s.pos = n.s_suppkey)
  select company, pos, code, zwjc, case when code <> '' then m end as exchange, case when code <> '' then '据巨潮资讯网（中国证监会指定披露平台），' || zwjc || ' 为 A 股上市公司，股票代码 ' || code || '（' || m || '）。' end as content from x""")
def _(t):
    names = t.supplier.select(F.expr("concat(s_name, case when s_suppkey % 2 = 0 then '有限公司' else '' end)").alias("company"))
    return IN.find_stock(names, t.sql(STOCKS)).select("company", "pos", "code", "zwjc", "listing.exchange", "listing.content")
