"""The feed reads profiles and postings once: same facts of a pair, taken before the pairs are made."""
from pyspark.sql import functions as F

from vacancylake.functions import geo as G, scoring as SC, text as T
from vacancylake.functions.base import text
from vacancylake.operators import feed as FD

NOW = "2001-06-01 00:00:00"
PAIR = ("id string, title string, company string, location string, job_type string, summary string, salary_text string, education string, job_scope string, country_code string, status string, "
        "skills array<string>, exclude_keywords array<string>, target_locations array<string>, target_regions array<string>, profile_scope string, highest_education string")
ROWS = [("1", "Data ΣΑΣ", "Firm", "北京", None, "Uses Python and SQL daily", "10K", "硕士", None, None, "active", ["python", " SQL ", "", None, "Python"], [" DAILY "], ["北京市"], [], "domestic", "本科"),
        ("2", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
        ("3", "Title", "Firm", "Beijing", "校招", "", None, "本科及以上，硕士优先", "domestic", "CN", "active", ["title"], ["校招", ""], ["北京", None], [], "domestic", "博士"),
        ("4", "Remote Σ", "Fi", "Remote", "x", "body ΟΔΟΣ", "a", "不限", "overseas", "", "active", ["οδος", "remote"], ["nothing"], ["上海"], ["Remote"], "all", "大专")]


def test_pair_facts_equal_reading_each_pair(spark):
    df = spark.createDataFrame(ROWS, PAIR).withColumns(SC.posting_reads()).withColumns(SC.profile_reads())
    for c, kind in (("status_", "string"), ("stage", "string"), ("category", "string"), ("explicit", "boolean"), ("industry", "string"), ("company_key", "string"), ("crawl_method", "string"),
                    ("source_enabled", "boolean"), ("last_seen_at", "timestamp"), ("first_seen_at", "timestamp"), ("user_fns", "array<string>"), ("target_categories", "array<string>"), ("target_company_keys", "array<string>")):
        df = df.withColumn(c, F.lit(None).cast(kind))
    df = (df.withColumn("kw", F.lit(None).cast("struct<fn:string,title_groups:array<int>,body_groups:array<int>,all_groups:array<int>,title:string,body:string>"))
          .withColumn("role_q", F.lit(None).cast("array<struct<units:array<array<int>>,literals:array<string>,fns:array<string>,siblings:array<int>,terms:array<string>>>")))
    hay = F.lower(F.concat_ws(" ", text("title"), text("summary")))
    n = F.length(F.trim(text("summary")))
    whole = F.lower(F.concat_ws(" ", *[F.nullif(text(c), F.lit("")) for c in ("title", "company", "location", "job_type", "summary", "salary_text")]))
    words = F.filter(F.transform("exclude_keywords", lambda w: F.lower(F.trim(w))), lambda w: w != "")
    edu = T.education_match("education", F.coalesce("highest_education", F.lit("")))
    plain = {"n_skills": F.size(F.filter("skills", lambda s: (F.trim(s) != "") & hay.contains(F.lower(F.trim(s))))), "summary_ok": n >= 60, "summary_long": n >= 200,
             "excluded": F.when(F.size(words) > 0, F.exists(words, lambda w: whole.contains(w))).otherwise(False),
             "edu_state": F.when(text("highest_education") == "", "na").when(edu == "pass", "match").when(edu == "degrade", "unknown").otherwise("mismatch")}
    in_city = F.exists("target_locations", lambda c: text("location").contains(c) | text("location").contains(G.city_wide(c)))
    got = df.select("id", F.struct(*SC.match_facts(NOW)).alias("m"), *[v.alias(k) for k, v in plain.items()], in_city.alias("in_city")).orderBy("id").collect()
    for r in got:
        assert {k: r["m"][k] for k in plain} == {k: r[k] for k in plain}, r
    assert [r["m"]["n_skills"] for r in got] == [3, got[1]["n_skills"], 1, 2] and [r["m"]["excluded"] for r in got] == [True, False, True, False]
    assert [r["m"]["loc_state"] for r in got if r["id"] in "13"] == ["match" if r["in_city"] else "mismatch" for r in got if r["id"] in "13"]


def test_profiles_are_stored_with_their_words(spark):
    one = (1, "all", [], ["alpha"], [], [], ["北京"], [], [], "", True)
    schema = ("user_id long, profile_scope string, target_regions array<string>, target_roles array<string>, target_keywords array<string>, target_companies array<string>, "
              "target_locations array<string>, target_industries array<string>, exclude_keywords array<string>, stage string, ready boolean")
    p = FD.with_query_sets(spark.createDataFrame([one], schema))
    assert "Join" not in p._jdf.queryExecution().optimizedPlan().toString()  # each use would plan and read them again
    assert p.inputFiles() and p.first()["target_locations"] == ["北京"]
