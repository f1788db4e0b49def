"""Discovery runs: audits of search results, provider summaries, run outcomes, candidate sources, proposed companies."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import company as CO, pages as PG
from ..functions.base import any_of, at, blank_to_null, col, let, text, ts
from . import core as C, coverage as CV

# fixed values: states, phases and messages of discovery runs
PHASES = {"queued": "queued", "running": "running", "success": "done", "partial_success": "done", "failed": "failed", "skipped": "failed"}
TERMINAL = ["success", "partial_success", "failed", "skipped"]
RATE_LIMIT = r"(?i)429|rate\s*limit|too many requests|限流|频率"
MESSAGES = {
    "provider_rate_limited": "Baidu Qianfan rate limited the realtime discovery request.",
    "provider_disabled": "Baidu Qianfan web search is disabled by BAIDU_QIANFAN_SEARCH_DISABLED.",
    "provider_failed": "All search providers failed before returning URLs.",
    "provider_no_results": "Search provider returned no extractable results.",
    "all_results_rejected": "Search provider returned URLs, but every result was rejected by source-quality filters.",
    "gate": "Supported parsers found candidates, but the job detail quality gate rejected them.",
    "parser_missing": "Official candidates were recorded, but no supported parser can produce high-quality job detail URLs yet.",
    "candidates_pending": "Discovered candidates are pending review or unsupported parsers; no jobs were written.",
    "no_detail": "Supported parsers produced no jobs with high-quality detail URLs.",
}
ERROR_CHARS, RESULTS_PER_QUERY, SLUGS = 4000, 10, 4

RESULT = "struct<url:string,title:string,snippet:string,provider_name:string,provider_query:string>"
DIAGNOSTIC = f"struct<query:string,provider_name:string,status:string,http_status:int,raw_results_count:long,extracted_urls_count:long,error:string,diagnostics:struct<rate_limited:boolean,disabled:boolean,disabled_by_env:boolean>,results:array<{RESULT}>>"
PROVIDER = DIAGNOSTIC.replace("struct<query", "struct<name:string,query", 1).replace("disabled_by_env:boolean>", f"disabled_by_env:boolean,queries:array<{DIAGNOSTIC}>>", 1)


def results_audit(runs: DataFrame, limit: int = RESULTS_PER_QUERY, known=None) -> DataFrame:
    """First results of every query with the class of their link: runs has run_id and providers (JSON array).

    A provider without query diagnostics is its own single query. Everything happens inside a run's row: two explodes and a
    slice, no shuffle. Runs whose JSON cannot be read give no rows.
    """
    ps = runs.select("run_id", F.posexplode(F.from_json("providers", f"array<{PROVIDER}>")).alias("provider_pos", "p"))
    own = F.struct(*[F.col(f"p.{c}").alias(c) for c in ("query", "provider_name", "results")])
    asked = F.transform(F.col("p.diagnostics.queries"), lambda q: F.struct(q["query"].alias("query"), q["provider_name"].alias("provider_name"), q["results"].alias("results")))
    qs = ps.select("run_id", "provider_pos", F.coalesce(blank_to_null("p.provider_name"), F.col("p.name")).alias("provider"), F.col("p.query").alias("asked"), F.posexplode(F.coalesce(asked, F.array(own))).alias("query_pos", "q"))
    rs = qs.select("run_id", "provider_pos", "provider", "asked", "query_pos", "q.query", "q.provider_name", F.posexplode(F.slice("q.results", 1, limit)).alias("result_pos", "r"))
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    f = PG.classify_link("r.url", known)
    return rs.select("run_id", "provider_pos", "query_pos", "result_pos", first("r.provider_name", "provider_name", "provider").alias("provider_name"), first("r.provider_query", "query", "asked").alias("query"),
                     text("r.title").alias("title"), text("r.url").alias("url"), text("r.snippet").alias("snippet"), f.alias("found"))


def rate_limited(http_status, error, flag) -> Column:
    return F.coalesce(col(flag), F.lit(False)) | F.coalesce(col(http_status) == 429, F.lit(False)) | text(error).rlike(RATE_LIMIT)


def provider_summary(queries: DataFrame) -> DataFrame:
    """One row per run and provider over its query diagnostics, in order of column pos.

    queries: (run_id, provider, pos, query, status, http_status, raw_results_count, extracted_urls_count, error, rate_limited,
    results array of struct(url, title, snippet)). Sums, the status ladder, the status code of the first limited query (else the
    first known one), distinct errors in order, and how many different links were found. Links are counted apart, so no task
    holds all results of a provider.
    """
    limited = rate_limited("http_status", "error", "rate_limited")
    at_least = lambda c: F.coalesce(F.col(c), F.lit(0))
    at_pos = lambda cond, value: F.min(F.when(cond, F.struct("pos", F.col(value).alias("v"))))["v"]
    g = queries.groupBy("run_id", "provider").agg(
        F.sum(at_least("raw_results_count")).alias("raw_results"), F.sum(at_least("extracted_urls_count")).alias("extracted_urls"), F.count("*").alias("queries"),
        F.count_if(F.col("status") == "provider_failed").alias("failed"), F.max(limited).alias("rate_limited"),
        at_pos(limited, "http_status").alias("_limited"), at_pos(F.col("http_status").isNotNull(), "http_status").alias("_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "query"))), lambda q: F.coalesce(q["query"], F.lit(""))), " | ").alias("query"))
    errors = queries.where(text("error") != "").groupBy("run_id", "provider", "error").agg(F.min("pos").alias("pos"))
    errors = errors.groupBy("run_id", "provider").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "error"))), lambda e: e["error"]), "\n").alias("error"))
    links = provider_links(queries).groupBy("run_id", "provider").agg(F.count("*").alias("links"))
    status = F.when(F.col("extracted_urls") > 0, F.when(F.col("failed") > 0, "partial_success").otherwise("success")).when(F.col("failed") > 0, "provider_failed").otherwise("no_results_found")
    rows = g.join(errors, ["run_id", "provider"], "left").join(links, ["run_id", "provider"], "left")
    code = F.coalesce(F.when(F.col("_limited") != 0, F.col("_limited")), F.when(F.col("_first") != 0, F.col("_first")))
    return rows.select("run_id", "provider", "query", status.alias("status"), code.alias("http_status"), "raw_results", "extracted_urls", "error", "rate_limited", at_least("links").alias("links"))


def provider_links(queries: DataFrame) -> DataFrame:
    """The first result of every link of a run and provider, in order: (run_id, provider, url, title, snippet, query)."""
    rows = queries.select("run_id", "provider", "pos", "query", F.posexplode("results").alias("n", "r")).where(text("r.url") != "")
    best = rows.groupBy("run_id", "provider", F.col("r.url").alias("url")).agg(F.min(F.struct("pos", "n", F.col("r.title").alias("title"), F.col("r.snippet").alias("snippet"), "query")).alias("b"))
    return best.select("run_id", "provider", "url", "b.title", "b.snippet", "b.query")


def run_status(runs: DataFrame) -> DataFrame:
    """Phase, counters and produced links of runs; diagnostics is JSON whose produced_jd_urls may hold other things than links."""
    status = F.coalesce(F.nullif(F.trim(text("status")), F.lit("")), F.lit("unknown"))
    phase = F.coalesce(*[F.when(status == s, F.lit(p)) for s, p in PHASES.items()], F.lit("unknown"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    # only JSON strings count: numbers and objects in the list are no links
    items = F.try_variant_get(F.try_parse_json("diagnostics"), "$.produced_jd_urls", "array<variant>")
    links = F.filter(F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda u: u.isNotNull() & (u != ""))
    return runs.select("id", status.alias("status"), phase.alias("phase"), status.isin(TERMINAL).alias("is_terminal"), n("jobs_created"), n("jobs_updated"), n("candidates_found"),
                       blank_to_null("failure_reason").alias("failure_reason"), blank_to_null("error_message").alias("error_message"), F.coalesce("started_at", "created_at").alias("started_at"), "finished_at",
                       F.coalesce(links, F.array().cast("array<string>")).alias("produced_urls"))


def discovery_outcome(runs: DataFrame, providers: DataFrame) -> DataFrame:
    """status, failure_reason and error_message of each run from its counters and its providers' states.

    runs: (id, total_urls, candidates_found, candidates_parsed, candidates_pending, candidates_failed, parser_supported (null:
    unknown), gate_failures, jobs_created, jobs_updated, errors array). providers: (run_id, status, http_status, error,
    rate_limited, disabled). Runs without providers count as without failures.
    """
    off = F.coalesce(F.col("disabled"), F.lit(False)) | text("error").rlike("(?i)disabled")
    p = providers.groupBy(F.col("run_id").alias("id")).agg(F.max(F.coalesce(F.col("status") == "provider_failed", F.lit(False))).alias("_failed"),
                                                           F.max(rate_limited("http_status", "error", "rate_limited")).alias("_limited"), F.max(off).alias("_off"))
    rows = runs.join(p, "id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    errors = F.nullif(F.substring(F.array_join(F.filter(F.coalesce("errors", F.array().cast("array<string>")), lambda e: text(e) != ""), "\n"), 1, ERROR_CHARS), F.lit(""))
    bad = (n("gate_failures") > 0) | (n("candidates_failed") > 0)

    def out(status, reason, message):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(lit(status).alias("status"), lit(reason).alias("failure_reason"), lit(message).alias("error_message"))

    told = lambda key: F.coalesce(errors, F.lit(MESSAGES[key]))
    written = out(F.when(yes("_failed") | bad, "partial_success").otherwise("success"), F.when(bad, "quality_gate_failed").when(yes("_limited"), "provider_rate_limited").when(yes("_failed"), "provider_failed"), errors)
    waiting = (n("candidates_found") > 0) & (n("candidates_pending") == n("candidates_found"))
    result = (F.when((n("jobs_created") > 0) | (n("jobs_updated") > 0), written)
               .when(yes("_limited"), out("failed", "provider_rate_limited", told("provider_rate_limited"))).when(yes("_off"), out("failed", "provider_disabled", told("provider_disabled")))
               .when(yes("_failed") & (n("total_urls") == 0), out("failed", "provider_failed", told("provider_failed")))
               .when(n("total_urls") == 0, out("failed", "provider_no_results", MESSAGES["provider_no_results"]))
               .when(n("candidates_found") == 0, out("failed", "all_results_rejected", MESSAGES["all_results_rejected"]))
               .when(bad, out("partial_success", "quality_gate_failed", told("gate")))
               .when(waiting & (F.col("parser_supported") == 0), out("partial_success", "parser_missing", MESSAGES["parser_missing"]))
               .when(waiting, out("partial_success", "candidates_pending", MESSAGES["candidates_pending"]))
               .when((n("candidates_found") > 0) & (n("candidates_parsed") == 0), out("partial_success", "quality_gate_failed", told("no_detail")))
               .otherwise(out(F.when(yes("_failed"), "partial_success").otherwise("success"), F.when(yes("_failed"), "provider_failed"), errors)))
    return rows.withColumn("_o", result).select("id", "_o.status", "_o.failure_reason", "_o.error_message")


def cached_outcome(runs: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Summary of runs answered from stored rows: (id, status, error_message) with candidates (run_id, status) and jobs (run_id)."""
    c = candidates.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("candidates_found"), *[F.count_if(F.col("status") == s).alias(f"candidates_{s}") for s in ("parsed", "pending", "failed")])
    j = jobs.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("jobs_reused"))
    rows = runs.select("id", "status", "error_message").join(c, "id", "left").join(j, "id", "left").na.fill(0)
    reused = F.col("jobs_reused") > 0
    reason = F.when(reused, None).when(F.col("candidates_found") > 0, F.when((F.col("candidates_failed") > 0) & (F.col("candidates_pending") == 0), "quality_gate_failed").otherwise("candidates_pending")).otherwise("provider_no_results")
    return rows.select("id", F.when(reused, "success").otherwise(F.coalesce("status", F.lit("partial_success"))).alias("status"), "candidates_found", "candidates_parsed", "candidates_pending", "candidates_failed", "jobs_reused",
                       reason.alias("failure_reason"), F.when(~reused, F.col("error_message")).alias("error_message"))


def candidate_rows(audit: DataFrame, status: str = "pending", fallback_company=None) -> DataFrame:
    """Candidate-source rows of audited links (results_audit), with all that is known about them as JSON in column reason."""
    f = F.col("found")
    company = F.coalesce(f["company"], F.lit(fallback_company).cast("string") if not isinstance(fallback_company, Column) else fallback_company)
    told = F.to_json(F.struct(blank_to_null("provider_name").alias("provider_name"), F.col("query").alias("provider_query"), blank_to_null("title").alias("title"), blank_to_null("snippet").alias("snippet"), "query", "url",
                              company.alias("company_guess"), f["source_type"].alias("source_type"), f["platform"].alias("detected_platform"), f["stored_platform"].alias("db_detected_platform"), f["confidence"].alias("confidence"),
                              F.lit(status).alias("status"), f["reason"].alias("reason"), f["keywords"].alias("matched_keywords"), f["signal"].alias("official_signal"), f["reject_reason"].alias("reject_reason"),
                              f["parser"].isNotNull().alias("parser_supported"), f["parser"].alias("parser_name")), {"ignoreNullFields": "false"})
    return audit.select("run_id", "query", company.alias("company"), "title", "url", f["source_type"].alias("source_type"), f["stored_platform"].alias("detected_platform"), f["confidence"].alias("confidence"), F.lit(status).alias("status"), told.alias("reason"))


def merged_reason(previous, status, why, now) -> Column:
    """A candidate's reason JSON with a later status merged in; what is no JSON object is kept under previous_reason."""
    base = F.from_json(F.when(text(previous).rlike(r"^\s*\{"), col(previous)), "map<string,variant>")
    as_value = lambda c: F.parse_json(F.to_json(F.array(c)))
    old = F.when(F.try_parse_json(col(previous)).isNotNull() & base.isNotNull(), base).when(text(previous) != "", F.create_map(F.lit("previous_reason"), F.variant_get(as_value(col(previous).cast("string")), "$[0]", "variant"))).otherwise(F.from_json(F.lit("{}"), "map<string,variant>"))
    new = F.create_map(*[x for k, v in (("status", status), ("status_update", why), ("status_updated_at", now)) for x in (F.lit(k), F.variant_get(as_value(v if isinstance(v, Column) else F.lit(v).cast("string")), "$[0]", "variant"))])
    kept = F.map_filter(old, lambda k, _v: ~k.isin("status", "status_update", "status_updated_at"))
    return F.to_json(F.map_concat(kept, new))


def clean_targets(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed companies worth probing: (batch, pos, company, cn, slugs, industry), first wins in a batch.

    Rows without a name or a usable slug (no blanks) go, and those that a stored company covers. Of rows with one name, or one
    folded name, the first that is left stays; a row between two others may link them only if it stays itself.
    """
    slugs = F.filter(F.transform(F.coalesce("slugs", F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: (s != "") & ~s.contains(" "))
    rows = proposed.select("batch", "pos", F.trim(text("company")).alias("company"), F.trim(F.coalesce(F.nullif(F.col("cn"), F.lit("")), F.trim(text("company")))).alias("cn"), slugs.alias("slugs"), F.trim(text("industry")).alias("industry"))
    rows = rows.where((F.col("company") != "") & (F.size("slugs") > 0)).withColumn("_key", CO.target_key("company"))
    covered = CV.company_covered(rows.select("company"), existing).where("covered").select("company")
    left = rows.join(covered, "company", "left_anti")
    # equal names have equal keys, so one partition holds all that can meet; a name without a key meets its equals only
    meet = F.when(F.col("_key") != "", F.concat(F.lit("k:"), "_key")).otherwise(F.concat(F.lit("n:"), "company"))
    first = C.latest_per_key(left.withColumn("_meet", meet), ["batch", "_meet"], [F.col("pos")])
    return first.select("batch", "pos", "company", "cn", F.slice("slugs", 1, SLUGS).alias("slugs"), "industry")


def expand_candidates(targets: DataFrame, templates: DataFrame, known: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Candidate boards of target companies: every slug in the address template of every platform it asks for.

    targets: (pos, company, slugs, ats, industry); templates: (adapter, template with {slug}); known: (company), whose names
    cover a target if they hold its token: the needle of the company's pattern (name, pattern), else its name. One row per
    address, that of the first target, platform and slug.
    """
    rows = targets
    token = F.lower(F.trim(F.replace(F.coalesce("pattern", "company"), F.lit("%"), F.lit("")))) if patterns is not None else F.lower(F.trim(F.replace(F.col("company"), F.lit("%"), F.lit(""))))
    if patterns is not None:
        one = patterns.where((text("name") != "") & (text("pattern") != "")).groupBy(F.col("name").alias("company")).agg(F.min_by("pattern", "pos").alias("pattern"))
        rows = rows.join(one, "company", "left")
    rows = rows.withColumn("_token", token)
    names = known.select(F.lower(F.col("company")).alias("known")).where("known is not null").distinct()
    needles = rows.select("_token").where("_token <> ''").distinct()
    covered = C.contains_join(names, "known", needles, "_token").select("_token").distinct()
    rows = rows.join(covered, "_token", "left_anti")
    wide = rows.select("pos", "company", "industry", "slugs", F.posexplode("ats").alias("ats_pos", "adapter")).join(templates, "adapter")
    wide = wide.select("pos", "company", "industry", "adapter", "ats_pos", "template", F.posexplode("slugs").alias("slug_pos", "slug")).withColumn("url", F.replace("template", F.lit("{slug}"), F.col("slug")))
    best = wide.groupBy("url").agg(F.min(F.struct("pos", "ats_pos", "slug_pos", "company", "adapter", "industry")).alias("b"))
    return best.select("url", "b.company", "b.adapter", "b.industry", F.lit("foreign").alias("segment"))
