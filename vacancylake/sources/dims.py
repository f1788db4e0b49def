"""Dimensions kept as JSON: watch lists and company industries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

ENTRY = "struct<name:string,pattern:string,parentPattern:string,brandTokens:array<string>>"


def must_apply_dim(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """{scope: path of a JSON object industry -> [entries]} as one row per scope and pattern with its industries."""
    out = None
    for scope, path in paths.items():
        text = spark.read.text(path, wholetext=True)
        m = F.from_json("value", f"map<string,array<{ENTRY}>>")
        rows = text.select(F.posexplode(F.map_entries(m)).alias("ipos", "i")).select("ipos", F.col("i.key").alias("industry"), F.posexplode("i.value").alias("epos", "e"))
        rows = rows.select(F.lit(scope).alias("scope"), "industry", "e.name", "e.pattern", F.col("e.parentPattern").alias("parent_pattern"),
                           F.coalesce("e.brandTokens", F.array().cast("array<string>")).alias("brand_tokens"), (F.col("ipos").cast("long") * (1 << 32) + F.col("epos")).alias("pos"))
        out = rows if out is None else out.unionByName(rows)
    first = lambda c: F.min_by(c, "pos").alias(c)
    return out.groupBy("scope", "pattern").agg(first("name"), first("parent_pattern"), first("brand_tokens"), F.array_sort(F.collect_set("industry")).alias("industries"), F.min("pos").alias("pos"))


def union_patterns(lists: DataFrame) -> DataFrame:
    """Distinct patterns over all scopes in first-seen order: scope by scope (column scope_pos, else by name), then by position."""
    scope = F.col("scope_pos") if "scope_pos" in lists.columns else F.col("scope") if "scope" in lists.columns else F.lit(0)
    first = lists.groupBy("pattern").agg(F.min(F.struct(scope.alias("scope"), "pos")).alias("f"))
    return first.select("pattern", F.col("f.scope").alias("scope"), F.col("f.pos").alias("pos"))


def keyword_groups(spark: SparkSession, path: str) -> list[tuple]:
    """JSON array of {"function": name or null, "terms": [...]} as the vocabulary that searches take as ``groups``.

    A vocabulary becomes part of the expressions, so it is read to the driver: meant for thousands of terms, not for data.
    Terms are trimmed; empty terms and groups without a term go.
    """
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<`function`:string,terms:array<string>>>")).alias("g")).select("g.*").collect()
    cleaned = [(r["function"], [t.strip() for t in r["terms"] or [] if t and t.strip()]) for r in rows]
    return [(fn, terms) for fn, terms in cleaned if terms]


def industry_overrides(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of [name, industry] pairs as (pos, name, industry); order matters."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("pos", "p"))
    return rows.select("pos", F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("industry"))


# declarative mappings of public job-board payloads: (array path, element schema, column -> expression)
PAYLOADS = {
    "greenhouse": ("$.jobs", "array<struct<title:string,absolute_url:string,updated_at:string,content:string,location:struct<name:string>>>",
                   {"title": "p.title", "jd_url": "p.absolute_url", "location": "p.location.name", "summary": "p.content", "posted_at": "p.updated_at"}),
    "lever": ("$", "array<struct<text:string,hostedUrl:string,createdAt:bigint,descriptionPlain:string,categories:struct<location:string,commitment:string>>>",
              {"title": "p.text", "jd_url": "p.hostedUrl", "location": "p.categories.location", "job_type": "p.categories.commitment", "summary": "p.descriptionPlain", "posted_at": "cast(p.createdAt as string)"}),
    "ashby": ("$.jobs", "array<struct<title:string,jobUrl:string,location:string,employmentType:string,descriptionHtml:string,publishedAt:string>>",
              {"title": "p.title", "jd_url": "p.jobUrl", "location": "p.location", "job_type": "p.employmentType", "summary": "p.descriptionHtml", "posted_at": "p.publishedAt"}),
    "iguopin": ("$.data.list", "array<struct<job_id:string,job_name:string,company_name:string,recruitment_type_cn:string,education_cn:string,experience_cn:string,end_time:string,contents:string,district_list:array<struct<area_cn:string>>>>",
                {"title": "p.job_name", "jd_url": "concat('https://www.iguopin.com/job/detail?id=', p.job_id)", "company": "p.company_name", "job_type": "p.recruitment_type_cn", "education": "p.education_cn",
                 "experience": "p.experience_cn", "deadline": "p.end_time", "summary": "p.contents", "location": "array_join(transform(p.district_list, d -> d.area_cn), '、')"}),
}
RAW_COLUMNS = ["title", "jd_url", "location", "job_type", "summary", "posted_at", "experience", "education", "deadline", "company"]


def map_payloads(df: DataFrame, kind: str, in_regions: bool = True) -> DataFrame:
    """Landed payloads (source_id, regions, payload JSON) as raw postings in the source's regions."""
    from ..functions.dates import iso_date
    from ..functions.geo import location_in_scope
    path, schema, mapping = PAYLOADS[kind]
    body = F.col("payload") if path == "$" else F.get_json_object("payload", path)
    rows = df.select("source_id", "regions", F.explode(F.from_json(body, schema)).alias("p"))
    out = rows.select("source_id", "regions", *[(F.expr(mapping[c]) if c in mapping else F.lit(None).cast("string")).alias(c) for c in RAW_COLUMNS])
    out = out.withColumn("posted_at", iso_date("posted_at"))
    return (out.where(location_in_scope("location", "regions")) if in_regions else out).drop("regions")
