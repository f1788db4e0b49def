"""Company hiring insights and graded claims."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import career as CR, company as CO, facts as FA, fixed as V, text as T
from ..functions.base import any_of, at, col, hours_between, js_round, text, ts
from . import core as C


def salary_band(jobs: DataFrame, min_sample: int = 5) -> DataFrame:
    """Median low and high monthly pay per company from postings that state a range."""
    rows = jobs.where("status = 'active'").select("company", T.monthly_k("salary_text").alias("m")).where("m is not null")
    g = rows.groupBy("company").agg(F.count("*").alias("sample"), F.expr("percentile(m.min_k, 0.5)").alias("lo"), F.expr("percentile(m.max_k, 0.5)").alias("hi"))
    return g.where(F.col("sample") >= min_sample).select("company", "sample", js_round("lo").cast("int").alias("min_k"), js_round("hi").cast("int").alias("max_k"))


def hiring_timing(jobs: DataFrame, min_sample: int = 5, min_bucket: int = 3) -> DataFrame:
    """Peak posting months per company and recruitment kind; social hiring over six months is rolling."""
    when_ = F.coalesce("posted_at", "first_seen_at")
    rows = jobs.where(when_.isNotNull()).select("company", T.recruit_bucket("job_type", "title").alias("bucket"), F.month(when_).alias("month"))
    dated = rows.groupBy("company").agg(F.count("*").alias("dated")).where(F.col("dated") >= min_sample)
    per = rows.where("bucket <> 'unknown'").groupBy("company", "bucket", "month").agg(F.count("*").alias("n"))
    tot = per.groupBy("company", "bucket").agg(F.sum("n").alias("total"), F.count("*").alias("months"))
    peak = C.numbered(per, ["company", "bucket"], [F.col("n").desc(), F.col("month")], "rank").where("rank <= 2")
    peaks = peak.groupBy("company", "bucket").agg(F.array_join(F.array_sort(F.collect_list("month")), "、").alias("peaks"))
    return (tot.where(F.col("total") >= min_bucket).join(peaks, ["company", "bucket"]).join(dated, "company")
            .select("company", "bucket", "dated", F.when((F.col("bucket") == "social") & (F.col("months") >= 6), "rolling").otherwise(F.col("peaks")).alias("peaks")))


def trend_pct(jobs: DataFrame, now) -> DataFrame:
    """Change of first sightings, last 30 days against the 30 before; null on a thin base."""
    n, t = at(now), F.col("first_seen_at")
    d30, d60 = n - F.expr("interval 30 days"), n - F.expr("interval 60 days")
    g = jobs.groupBy("company").agg(F.count_if(t >= d30).alias("recent"), F.count_if((t >= d60) & (t < d30)).alias("prior"))
    return g.withColumn("trend", F.when(F.col("prior") >= 3, js_round((F.col("recent") - F.col("prior")) / F.col("prior") * 100).cast("int")))


def hiring_signal(active, trend, band) -> Column:
    """struct(momentum, intensity) from the trend and the postings per employee."""
    t = col(trend)
    emp = None
    for b, n in V.HEADCOUNT_APPROX.items():
        emp = F.when(col(band) == b, n) if emp is None else emp.when(col(band) == b, n)
    ratio = col(active) / emp
    return F.struct(F.when(t >= 25, "expanding").when(t <= -25, "tightening").otherwise("steady").alias("momentum"),
                    F.when(col(active) > 0, F.when(ratio >= 0.015, "high").when(ratio >= 0.004, "mid").when(ratio.isNotNull(), "low")).alias("intensity"))


def headcount_band(n) -> Column:
    """Fixed value bands of a headcount."""
    c = col(n)
    return (F.when(c <= 0, F.lit(None)).when(c < 100, "1-100").when(c < 500, "100-500").when(c < 1000, "500-1000").when(c < 5000, "1000-5000").when(c < 10000, "5000-1万")
             .when(c < 50000, "1万-5万").when(c < 100000, "5万-10万").when(c.isNotNull(), "10万+"))


def hiring_snapshot(jobs: DataFrame, min_sample: int = 3) -> DataFrame:
    """Active count, three top cities and functions, mix of recruitment kinds."""
    j = jobs.where("status = 'active'").select("company", T.city_head("location").alias("city"), T.coarse_function("title").alias("fn"), T.recruit_bucket("job_type", "title").alias("bucket"))
    n = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    base = j.groupBy("company").agg(F.count("*").alias("active_count"), n("campus"), n("intern"), n("social"), n("unknown")).where(F.col("active_count") >= min_sample)
    top = lambda df, c, name: C.top_n_frequent(df, ["company"], c, 3).groupBy("company").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c, "n"))), lambda x: F.concat(x[c], F.lit(":"), x["n"].cast("string"))), ",").alias(name))
    return base.join(top(j, "city", "top_cities"), "company", "left").join(top(j.where("fn <> '其他'"), "fn", "top_functions"), "company", "left")


def hiring_monthly(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("company", F.date_format("first_seen_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("postings"), F.count_if(F.col("status") == "active").alias("active"))


def company_insights(jobs: DataFrame, now, bands: DataFrame | None = None) -> DataFrame:
    """One sheet per company: hiring, pay and trend figures of all postings at once."""
    s = hiring_snapshot(jobs).join(salary_band(jobs), "company", "left").join(trend_pct(jobs.where("status = 'active'"), now).select("company", "trend"), "company", "left")
    s = s.join(bands.select("company", "band"), "company", "left") if bands is not None else s.withColumn("band", F.lit(None).cast("string"))
    sig = hiring_signal("active_count", "trend", "band")
    return s.withColumn("momentum", sig["momentum"]).withColumn("intensity", sig["intensity"])


def first_party(subs: DataFrame, min_count: int = 5) -> DataFrame:
    """Approved reports per company: average rating, shown only from enough of them."""
    a = subs.where("status = 'approved'").groupBy("company").agg(F.count("*").alias("count"), F.round(F.avg("rating"), 1).alias("average_rating"))
    return a.withColumn("visible", F.col("count") >= min_count)


# fixed values: wording rules of displayed claims
BANNED = [r"我们(?:认定|认为|断定|判定|觉得)", r"本产品(?:认为|认定|判定|断定)", r"平台(?:认定|断定|判定)", r"(?:毫无疑问|绝对|百分百|一定)是最"]
ATTRIBUTION = r"据|根据|反馈|公开|官方|财报|公告|招股|统计|调查|报道|多位|多家|网友|社区|[0-9]+\s*[位名家]"


def items_with_sources(items: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with their evidence counted: usable sources, distinct publishers, unmasked ones."""
    s = links.join(sources.select(F.col("id").alias("insight_source_id"), "url", "publisher", F.col("deidentified").alias("src_masked")), "insight_source_id")
    ok = (text("url") != "") & F.col("src_masked")
    g = s.groupBy("item_id").agg(F.count_if(ok).alias("n_sources"), F.count_if(~F.col("src_masked")).alias("n_unmasked"),
                                 F.countDistinct(F.when(ok, F.lower(F.trim(F.coalesce("publisher", "url"))))).alias("n_publishers"))
    return items.join(g.withColumnRenamed("item_id", "id"), "id", "left").na.fill(0, ["n_sources", "n_unmasked", "n_publishers"])


def insight_gate(rows: DataFrame, now) -> DataFrame:
    """displayable, outdated and failure of claims that carry their evidence counts."""
    grade = (F.when(F.col("grade") == "fact", F.col("n_sources") >= 1)
              .when(F.col("grade") == "experience", (F.coalesce("sample_size", F.lit(0)) >= 5) & (F.col("n_publishers") >= 2)).otherwise(False))
    banned = any_of(text("content").rlike(p) for p in BANNED)
    lint = ~banned & ((F.col("grade") != "experience") | text("content").rlike(ATTRIBUTION))
    window = (F.trim(text("time_window")) != "") | F.col("valid_from").isNotNull() | F.col("valid_until").isNotNull()
    verified = (F.col("status") == "active") & F.col("deidentified") & (F.col("n_unmasked") == 0) & grade & lint & window
    old = F.coalesce(F.to_date("valid_until") < F.to_date(at(now)), F.lit(False))
    v = F.coalesce(verified, F.lit(False))
    return (rows.withColumn("displayable", v & ~old).withColumn("outdated", v & old)
            .withColumn("failure", F.when(~v, "insight_unverified").when(old, "insight_outdated")))


def age_label(verified_at, now) -> Column:
    days = hours_between(at(now), verified_at) / 24
    return F.when(days <= 90, "fresh").when(days <= 270, "recent").when(days <= 540, "aging").when(days.isNotNull(), "stale")


def profile_keys(profiles: DataFrame) -> DataFrame:
    """(pos, profile_id, key): the folded names a profile answers to."""
    alias = profiles.select("pos", "profile_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_a"))
    return alias.select("pos", "profile_id", CO.match_key("_a").alias("key")).where("key <> ''").distinct()


def matching_profiles(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """(company, profile_id): every profile that a company text matches, by equal keys or an eligible substring either way."""
    n = names.select("company").distinct().withColumn("q", CO.match_key("company")).where("q <> ''")
    a = profile_keys(profiles)
    equal = n.join(a, n["q"] == a["key"]).select("company", "profile_id")
    inside = C.contains_join(n, "q", a.where(CO.long_enough("key")), "key").select("company", "profile_id")
    around = C.contains_join(a, "key", n.where(CO.long_enough("q")), "q").select("company", "profile_id")
    return equal.union(inside).union(around).distinct()


CAREER_NOTE_CHARS = 48


def career_note(title, content) -> Column:
    """Title of an item, or its content cut to CAREER_NOTE_CHARS."""
    c = F.trim(text(content))
    cut = F.when(F.length(c) > CAREER_NOTE_CHARS, F.concat(F.substring(c, 1, CAREER_NOTE_CHARS), F.lit("…"))).otherwise(F.nullif(c, F.lit("")))
    return F.coalesce(F.nullif(F.trim(text(title)), F.lit("")), cut)


def company_timing(items: DataFrame, now) -> DataFrame:
    """Per company: status, label and detail of its timing items, and the first pay and caution notes.

    items: (company, dimension, pos, time_window, title, content). Each row is judged where it lies; only the best state and
    the first notes meet, so no list of a company's items is built.
    """
    month = F.month(at(now))
    state = CR.window_status("time_window", month)
    timed = F.when(F.col("dimension") == "timing", F.struct(CR.status_rank("_state").alias("r"), (-F.col("pos")).alias("p"), F.col("_state").alias("s"), F.col("time_window").alias("w")))
    first = lambda d: F.min(F.when(F.col("dimension") == d, F.struct("pos", career_note("title", "content").alias("note"))))["note"]
    g = items.withColumn("_state", state).groupBy("company").agg(F.max(timed).alias("_t"), first("compensation_intensity").alias("comp_note"), first("culture").alias("caution_note"))
    return g.select("company", F.col("_t.s").alias("status"), F.col("_t.w").alias("detail"), "comp_note", "caution_note")


def career_path(wanted: DataFrame, items: DataFrame, now, lists: DataFrame | None = None, key: str = "list") -> DataFrame:
    """Recommended companies per user: timing first, then open postings, then the given order (column rank, from 1).

    wanted: (user_id, pos, company, display_name, job_count). Companies without items have an unknown timing and no notes.
    With ``lists`` (key, pos, company, display_name, job_count), wanted is (user_id, key): a list is told and ranked once and
    handed to its users; only users of several lists are ranked on their own.
    """
    rows = (wanted if lists is None else lists).join(company_timing(items, now), "company", "left")
    rows = rows.withColumn("status", F.coalesce("status", F.lit("unknown"))).withColumn("job_count", F.coalesce("job_count", F.lit(0)))
    jobs = F.when(F.col("job_count") > 0, F.concat(F.col("job_count").cast("string"), F.lit(" 个在招岗位")))
    reasons = F.array_compact(F.array(CR.status_label("status"), jobs, F.when(F.col("caution_note").isNotNull(), F.lit("有温馨提示"))))
    rows = rows.withColumn("label", CR.status_label("status")).withColumn("reasons", reasons)
    order = [CR.status_weight("status").desc(), F.col("job_count").desc(), F.col("pos")]
    if lists is None:
        return C.numbered(rows, ["user_id"], order, "rank")
    users = wanted.withColumn("_lists", F.count("*").over(Window.partitionBy("user_id")))
    shared = C.spread_join(users.where("_lists = 1").drop("_lists"), C.numbered(rows, [key], order, "rank"), [key])
    own = C.numbered(C.spread_join(users.where("_lists > 1").drop("_lists"), rows, [key]), ["user_id"], order, "rank")
    return shared.unionByName(own)


def career_notes(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """Path and culture items of a user's companies: (user_id, kind, pos, item_pos, company, title, content)."""
    kind = F.when(F.col("dimension") == "path", "path_note").when(F.col("dimension") == "culture", "caution")
    i = items.select("company", kind.alias("kind"), F.col("pos").alias("item_pos"), "title", "content").where("kind is not null")
    return C.spread_join(wanted, i, ["company"]).select("user_id", "kind", "pos", "item_pos", F.coalesce("display_name", "company").alias("company"), "title", "content")


def career_header(profiles: DataFrame, path: DataFrame) -> DataFrame:
    """Per profile (user_id, target_roles, seniority, target_locations): whether it says anything, and why a report is empty."""
    some = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")) > 0
    n = path.groupBy("user_id").agg(F.count("*").alias("recommendations"))
    rows = profiles.withColumn("has_profile", some("target_roles") | some("target_locations") | (text("seniority") != "")).join(n, "user_id", "left")
    empty = F.when(F.col("has_profile"), "insight_unverified").otherwise("no_profile")
    return rows.select("user_id", "has_profile", F.coalesce("recommendations", F.lit(0)).alias("recommendations"), F.when(F.coalesce("recommendations", F.lit(0)) == 0, empty).alias("failure_reason"))


def match_profile(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """Best profile of each company text: equal keys first, else an eligible substring, lowest profile position."""
    n = names.select("company").distinct().withColumn("q", CO.match_key("company")).where("q <> ''")
    a = profile_keys(profiles)
    equal = n.join(a, n["q"] == a["key"]).select("company", "pos", "profile_id", F.lit(0).alias("how"))
    inside = C.contains_join(n, "q", a.where(CO.long_enough("key")), "key").select("company", "pos", "profile_id", F.lit(1).alias("how"))
    around = C.contains_join(a, "key", n.where(CO.long_enough("q")), "q").select("company", "pos", "profile_id", F.lit(1).alias("how"))
    return C.latest_per_key(equal.unionByName(inside).unionByName(around), ["company"], [F.col("how"), F.col("pos")])


def counts_by_profile(counts: DataFrame, profiles: DataFrame, enough: int = 3) -> DataFrame:
    """Active postings summed over all company spellings of a profile."""
    m = match_profile(counts, profiles).select("company", "profile_id")
    g = counts.join(m, "company").groupBy("profile_id").agg(F.sum("job_count").alias("active"))
    return profiles.select("profile_id").distinct().join(g, "profile_id", "left").select(
        "profile_id", F.coalesce("active", F.lit(0)).alias("active"), (F.coalesce("active", F.lit(0)) >= enough).alias("available"))


def claim_status(claims: DataFrame, min_conf: float = 0.6, review_floor: float = 0.4) -> DataFrame:
    """active / pending_review / drop from a judgement and the number of publishers."""
    conf = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    s = F.when((F.col("verdict") == "entailment") & (conf >= min_conf), "active").when((F.col("verdict") == "entailment") & (conf >= review_floor), "pending_review").otherwise("drop")
    enough = F.col("n_publishers") >= F.when(F.col("grade") == "experience", 2).otherwise(1)
    return claims.withColumn("status", F.when(enough, s).otherwise("drop"))


def retire_generation(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Active claims from the public web that a company's run (company_id, run_start, wrote_any) did not renew are retired.

    A run that wrote nothing retires nothing; claims of other origin stay.
    """
    r = runs.where("wrote_any").groupBy("company_id").agg(F.max("run_start").alias("_run"))
    old = (F.col("status") == "active") & (F.col("origin") == "public_web") & (F.col("last_verified_at") < F.col("_run"))
    return items.join(r, "company_id", "left").withColumn("status", F.when(old, "retired").otherwise(F.col("status"))).drop("_run")


def pick_evidence(results: DataFrame, n: int = 3) -> DataFrame:
    """Evidence of a claim: the cited source, then other publishers, one row each."""
    per = C.latest_per_key(results, ["claim_id", "publisher"], [F.col("cited").desc(), F.col("pos")])
    return C.top_n_per(per, ["claim_id"], [F.col("cited").desc(), F.col("pos")], n)


def annual_financials(facts: DataFrame) -> DataFrame:
    """Latest fiscal year per company and metric with its change on the year before."""
    from pyspark.sql import Window
    w = Window.partitionBy("company", "metric").orderBy("fiscal_end")
    y = facts.withColumn("prev", F.lag("value").over(w))
    last = C.latest_per_key(y, ["company", "metric"], [F.col("fiscal_end").desc()])
    return last.withColumn("yoy_pct", F.when(F.col("prev") != 0, F.bround((F.col("value") - F.col("prev")) / F.abs("prev") * 100, 1)))


def company_facts(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """Facts of entity JSON with references resolved: entities (company_id, entity), labels (qid, label, one row a qid).

    References are looked up by one join over (company, kind, place, qid) rows; the JSON itself does not travel. Rows that are
    no entity keep null facts. company_id must be unique.
    """
    parsed = entities.select("company_id", FA.entity_facts("entity").alias("f"))
    refs = parsed.select("company_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"f.{c}").alias("ids")) for k, c in (("exchange", "exchange_ids"), ("hq", "hq_ids"), ("industry", "industry_ids"))])).alias("r"))
    refs = refs.select("company_id", "r.kind", F.posexplode("r.ids").alias("at", "qid")).join(labels.where(text("label") != ""), "qid", "left")
    named = refs.withColumn("name", F.when(F.col("kind") == "exchange", F.coalesce(FA.known_exchange("qid"), "label")).otherwise(F.col("label"))).where("name is not null")
    first = lambda k: F.min(F.when(F.col("kind") == k, F.struct("at", "name")))["name"].alias(k)
    exchanges = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "exchange", F.struct("at", "name")))), lambda x: x["name"])).alias("exchanges")
    g = named.groupBy("company_id").agg(exchanges, first("hq"), first("industry"))
    kept = ["qid", "label", "entity_url", "listed", "ticker", "official_site", "founded_year", "employees"]
    rows = parsed.select("company_id", *[f"f.{c}" for c in kept]).join(g, "company_id", "left")
    return rows.withColumn("exchanges", F.coalesce("exchanges", F.array().cast("array<string>"))).withColumn("headcount_band", headcount_band("employees"))


def listing_rows(facts: DataFrame) -> DataFrame:
    """Listing claims and profile columns of company facts: (company_id, listing, profile); rows without facts go."""
    f = F.struct(*[F.col(c) for c in facts.columns if c != "company_id"])
    return facts.where("qid is not null").select("company_id", FA.entity_listing(f).alias("listing"), FA.profile_columns(f, F.col("headcount_band")).alias("profile"))


def find_stock(companies: DataFrame, stocks: DataFrame) -> DataFrame:
    """Stock of each company name: stocks (pos, code, zwjc, orgId); equal names or equal names without a legal suffix, first in the list."""
    n = companies.select("company").distinct().select("company", F.trim(text("company")).alias("n")).where("n <> ''")
    s = stocks.select("pos", "code", F.trim(text("zwjc")).alias("zwjc"), "orgId").where("zwjc <> ''")
    equal = n.join(s, n["n"] == s["zwjc"]).select("company", "pos", "code", "zwjc", "orgId")
    keyed = n.withColumn("k", FA.stock_name_key("n")).where("k <> ''").join(s.withColumn("k", FA.stock_name_key("zwjc")), "k").select("company", "pos", "code", "zwjc", "orgId")
    best = equal.union(keyed).groupBy("company").agg(F.min(F.struct("pos", "code", "zwjc", "orgId")).alias("s"))
    return best.select("company", "s.*", FA.stock_listing("s.code", "s.zwjc", "s.orgId").alias("listing"))
