"""Base columns, counts and windows."""
from pyspark.sql import functions as F

from ..functions import text as T, tokens as K, urls as U
from ..functions.base import at
from ..operators import core as C
from .registry import query
from .roles import NOW

# canonical form of a link, for engines without our function
CANON = """case when {u} is null or trim({u}) = '' or contains({u}, '#') then trim({u}) else
  concat(regexp_replace(split_part(trim({u}), '?', 1), '/+$', ''),
    case when len(list_filter(string_split(case when contains({u}, '?') then substr(trim({u}), strpos(trim({u}), '?') + 1) else '' end, '&'),
      lambda p: p <> '' and not starts_with(lower(split_part(p, '=', 1)), 'utm_') and lower(split_part(p, '=', 1)) not in
      ('spm','scm','bd_vid','gclid','fbclid','msclkid','yclid','hmsr','hmpl','hmcu','hmkw','hmci','_ga','gio_link_id'))) > 0 then
    concat('?', array_to_string(list_filter(string_split(case when contains({u}, '?') then substr(trim({u}), strpos(trim({u}), '?') + 1) else '' end, '&'),
      lambda p: p <> '' and not starts_with(lower(split_part(p, '=', 1)), 'utm_') and lower(split_part(p, '=', 1)) not in
      ('spm','scm','bd_vid','gclid','fbclid','msclkid','yclid','hmsr','hmpl','hmcu','hmkw','hmci','_ga','gio_link_id')), '&'))
    else '' end) end"""


def canon(column: str) -> str:
    return CANON.replace("{u}", column)


VALID = "length(trim(summary, ' ')) >= 60"
DEDUPED = f"""with d as (select id, company, summary, status, row_number() over (
    partition by {canon('jd_url')} order by last_seen_at desc nulls last, first_seen_at desc nulls last, id desc) as rn
  from r_jobs where status = 'active') """


def dedupe_active(jobs):
    """Newest active row per canonical URL; the others are demoted to removed."""
    active = jobs.where(F.col("status") == "active").withColumn("canonical_jd_url", U.canonical_url("jd_url"))
    ranked = C.numbered(active, ["canonical_jd_url"], [F.col("last_seen_at").desc_nulls_last(),
                        F.col("first_seen_at").desc_nulls_last(), F.col("id").desc()])
    return ranked.withColumn("status", F.when(F.col("rn") == 1, "active").otherwise("removed"))


@query("flagship_active_by_company", DEDUPED + f"""
  select company, count(*) as active_valid from d where rn = 1 and {VALID} group by company""")
def flagship(t):
    # the test is made where the texts lie; only its outcome is shuffled
    tested = t.jobs.select("id", "company", "jd_url", "status", "last_seen_at", "first_seen_at", T.is_valid_active("status", "summary").alias("valid"))
    kept = dedupe_active(tested).where("status = 'active' and valid")
    return kept.groupBy("company").agg(F.count("*").alias("active_valid"))


@query("canonical_url_pages", f"select page_id, {canon('url')} as canonical from pages")
def _(t):
    return t.pages.select("page_id", U.canonical_url("url").alias("canonical"))


@query("canonical_url_posts", f"select id, {canon('jd_url')} as canonical from r_posts")
def _(t):
    return t.posts.select("id", U.canonical_url("jd_url").alias("canonical"))


TOKENS = """list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> '')"""
PAIRS = """flatten(list_transform(WORDS, lambda w: case when regexp_full_match(w, '[a-z0-9]+') or length(w) = 1
  then [w] else list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) end))"""


@query("search_tokens_documents", "select doc_id, len(tk) as n_tokens, md5(array_to_string(tk, ' ')) as tokens_md5 from (select doc_id, "
       + PAIRS.replace("WORDS", TOKENS.replace("{c}", "text")) + " as tk from documents)")
def _(t):
    tk = K.search_tokens("text")
    return t.documents.select("doc_id", F.size(tk).cast("long").alias("n_tokens"), F.md5(F.array_join(tk, " ")).alias("tokens_md5"))


@query("search_doc_posts", "select id, array_to_string(list_sort(list_distinct(" + PAIRS.replace("WORDS", TOKENS.replace(
       "{c}", "concat_ws(' ', title, company, coalesce(location, ''), coalesce(job_type, ''))")) + ")), ' ') as doc from r_posts")
def _(t):
    return t.posts.select("id", F.array_join(F.sort_array(K.search_doc("title", "company", "location", "job_type")), " ").alias("doc"))


@query("content_hash", "select id, sha256(concat(title, '|', coalesce(location, ''), '|', coalesce(summary, ''))) as content_hash from r_jobs")
def _(t):
    return t.jobs.select("id", T.content_hash("title", "location", "summary").alias("content_hash"))


@query("clean_title", "select id, trim(regexp_replace(trim(regexp_replace(concat('  ', title, ' -  ', company), '\\s+', ' ', 'g')), '\\s+[-–—]\\s+.*$', '')) as title from r_posts")
def _(t):
    return t.posts.select("id", T.clean_title(F.concat(F.lit("  "), "title", F.lit(" -  "), "company")).alias("title"))


@query("count_valid_active", f"select count(*) as n from r_jobs where status = 'active' and {VALID}")
def _(t):
    return t.jobs.agg(F.count_if(T.is_valid_active("status", "summary")).alias("n"))


@query("count_recent", f"""select count(*) filter (last_seen_at >= timestamp '{NOW}' - interval 30 day) as seen_30d,
  count(*) filter (coalesce(job_scope, 'domestic') = 'domestic') as domestic, count(*) filter (job_scope = 'overseas') as overseas
  from r_posts where status = 'active'""")
def _(t):
    scope = F.coalesce("job_scope", F.lit("domestic"))
    return t.posts.where("status = 'active'").agg(
        F.count_if(F.col("last_seen_at") >= at(NOW) - F.expr("interval 30 days")).alias("seen_30d"),
        F.count_if(scope == "domestic").alias("domestic"), F.count_if(scope == "overseas").alias("overseas"))


@query("active_companies", "select distinct company from r_posts where status = 'active' and company is not null and company <> ''")
def _(t):
    return t.posts.where("status = 'active' and company <> ''").select("company").distinct()


@query("active_counts", f"select trim(company, ' ') as company, count(*) as job_count from r_jobs where status = 'active' and {VALID} and trim(company, ' ') <> '' group by 1")
def _(t):
    rows = t.jobs.where(T.is_valid_active("status", "summary") & (F.trim("company") != ""))
    return rows.groupBy(F.trim("company").alias("company")).agg(F.count("*").alias("job_count"))


@query("status_counts", "select status, count(*) as n from r_posts group by status")
def _(t):
    return t.posts.groupBy("status").agg(F.count("*").alias("n"))


@query("latest_run_per_source", "select source_id, id, status from (select *, row_number() over (partition by source_id order by started_at desc nulls last, id desc) rn from r_runs) where rn = 1")
def _(t):
    return C.latest_per_key(t.runs, ["source_id"], [F.col("started_at").desc_nulls_last(), F.col("id").desc()]).select("source_id", "id", "status")


@query("dedupe_active", DEDUPED + "select id, case when rn = 1 then 'active' else 'removed' end as status from d")
def _(t):
    return dedupe_active(t.jobs).select("id", "status")


@query("duplicate_source_map", """select id as source_id, keep_id from (select id, first_value(id) over (partition by industry, adapter_name order by id) as keep_id from r_sources) where id <> keep_id""")
def _(t):
    w = C.Window.partitionBy("industry", "adapter_name").orderBy("id")
    m = t.sources.withColumn("keep_id", F.first("id").over(w))
    return m.where("id <> keep_id").select(F.col("id").alias("source_id"), "keep_id")


@query("latest_page", "select id, title from r_posts where status = 'active' order by first_seen_at desc, id limit 50 offset 20")
def _(t):
    return t.posts.where("status = 'active'").orderBy(F.col("first_seen_at").desc(), "id").offset(20).limit(50).select("id", "title")


@query("top_titles", "select company, title, n, rank from (select company, title, count(*) as n, row_number() over (partition by company order by count(*) desc, title) as rank from r_posts group by company, title) where rank <= 3")
def _(t):
    return C.top_n_frequent(t.posts, ["company"], "title", 3)
