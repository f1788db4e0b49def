"""Duplicate, completeness and page audits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, urls as U
from ..functions.base import any_contains, any_of, at, col, let, text
from . import core as C

# fixed values: what a closed posting's page says
DEAD_MARKERS = ["职位不存在", "岗位不存在", "该职位不存在", "职位已下线", "已下线", "职位已关闭", "岗位已关闭", "已结束", "停止招聘", "已招满",
                "职位已过期", "职位不见了", "page not found", "not found", "404", "this job is no longer", "position is no longer",
                "no longer available", "已失效", "招聘已结束"]


def duplicate_audit(jobs: DataFrame) -> DataFrame:
    """Groups of active postings under one raw or canonical URL: rows to demote and conflicting names."""
    a = jobs.where("status = 'active'").withColumn("canonical_jd_url", U.canonical_url("jd_url"))
    def groups(key):
        g = a.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("company").alias("companies"), F.countDistinct("title").alias("titles")).where("n > 1")
        return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
                     F.count_if(F.col("companies") > 1).alias("name_conflicts"), F.count_if(F.col("titles") > 1).alias("title_conflicts")).select(F.lit(key).alias("key"), "*")
    return groups("jd_url").union(groups("canonical_jd_url"))


def completeness(jobs: DataFrame, now) -> DataFrame:
    """Missing fields and staleness of active postings."""
    n = at(now)
    old = lambda d: F.count_if(F.col("last_seen_at") < n - F.expr(f"interval {d} days")).alias(f"stale_{d}d")
    return jobs.where("status = 'active'").agg(F.count("*").alias("total"), *C.missing_count(jobs, ["location", "job_type", "salary_text", "education", "deadline"]), old(7), old(14), old(30))


def page_verdict(body, title) -> Column:
    """dead / alive / unsure / suspect of a rendered page's text against the posting title."""
    def judge(low):
        head = F.lower(F.substring(F.trim(text(title)), 1, 8))
        return (F.when(any_contains(low, DEAD_MARKERS), "dead").when((head != "") & low.contains(head), "alive")
                 .when(F.length(F.trim(low)) < 40, "unsure").otherwise("suspect"))
    return let(F.lower(text(body)), judge)


def blocked_page(body, status) -> Column:
    def judge(low):
        return ((col(status) == 403) | low.contains("captcha") | (low.contains("verify") & low.contains("human"))
                | (low.contains("login") & low.contains("<form") & low.contains("password")) | any_contains(low, ["访问受限", "请求过于频繁", "您的ip"]))
    return let(F.lower(text(body)), judge)


def verdict_by_host(checks: DataFrame) -> DataFrame:
    return checks.groupBy(U.host("url").alias("host")).pivot("verdict", ["alive", "dead", "suspect", "unsure"]).count().na.fill(0)


def source_verification(results: DataFrame) -> DataFrame:
    """Verification outcomes per adapter and sources whose postings live on another host."""
    return results.groupBy("adapter_name").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("success", "partial_success", "failed", "skipped")],
                                               F.count_if(F.col("source_host") != F.col("job_host")).alias("host_mismatch"))


def filter_funnel(jobs: DataFrame, combos: DataFrame) -> DataFrame:
    """Active postings per request (city, type) after each filter: city, then type."""
    a = jobs.where("status = 'active'").groupBy(F.lower(text("location")).alias("loc"), F.coalesce("job_type", F.lit("")).alias("jt")).agg(F.count("*").alias("n"))
    # requests meet the distinct (place, type) pairs, not the postings
    hit = C.contains_join(a.select("loc").distinct(), "loc", combos, "city")
    j = a.join(hit, "loc")
    return j.groupBy("combo_id").agg(F.sum("n").alias("in_city"), F.sum(F.when(F.col("jt") == F.col("job_type"), F.col("n")).otherwise(0)).alias("of_type"))


def facets(cards: DataFrame) -> DataFrame:
    """Distinct values per facet."""
    f = lambda name, c: cards.select(F.lit(name).alias("facet"), c.alias("value")).where("value is not null and value <> ''").distinct()
    return f("city", T.city_head("location")).union(f("education", T.education_level("education"))).union(f("function", T.coarse_function("title")))


def source_acceptance(jobs: DataFrame, n: int = 5) -> DataFrame:
    """Per source: active and linked postings, and its newest samples."""
    a = jobs.where("status = 'active'")
    ok = (text("jd_url") != "") & (text("title") != "")
    g = a.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(ok).alias("healthy"))
    s = C.numbered(a.select("source_id", "id", "first_seen_at"), ["source_id"], [F.col("first_seen_at").desc(), F.col("id")], "_rn").where(F.col("_rn") <= n)
    top = s.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "id"))), lambda x: x["id"]), ",").alias("samples"))
    return g.join(top, "source_id", "left")


def page_fields(html) -> Column:
    """struct(title, description, text length, has_date) read from a page."""
    h = text(html)
    title = T.strip_tags(T.unescape_html(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    desc = F.regexp_extract(h, r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""", 1)
    return F.struct(F.nullif(title, F.lit("")).alias("title"), F.nullif(desc, F.lit("")).alias("description"),
                    h.rlike(r"\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}").alias("has_date"))
