"""Rules that earlier rows did not exercise: shared patterns, lost companies, nested payloads, open-ended ranges."""
import json

from pyspark.sql import functions as F

from vacancylake.functions import text as T
from vacancylake.operators import campus, coverage, ingest, insights, validate

NOW = "2001-08-01 00:00:00"


def jobs(spark, rows):
    made = spark.createDataFrame(rows, "company string, title string, summary string")
    return made.select("*", F.lit("active").alias("status"), F.lit(NOW).cast("timestamp").alias("first_seen_at"), F.lit(NOW).cast("timestamp").alias("enrich_checked_at"))


def test_list_rows_may_share_a_pattern(spark):
    j = jobs(spark, [("Parent 1", f"Widget {i}", "x" * 80) for i in range(4)] + [("Brand", "Clerk", "x" * 80)])
    dim = spark.createDataFrame([(1, "a", "%Brand%", "%Parent%", ["widget"]), (2, "b", "%Brand%", None, None), (3, "c", "%Brand%", "%Parent%", ["widget"])],
                                "pos int, name string, pattern string, parent_pattern string, brand_tokens array<string>")
    got = {r["pos"]: (r["healthy"], r["parent_healthy"], r["via_parent"]) for r in coverage.must_apply_coverage(j, dim, NOW).collect()}
    assert got == {1: (5, 4, True), 2: (1, 0, False), 3: (5, 4, True)}


def test_a_company_that_lost_everything_is_not_healthy(spark):
    dim = spark.createDataFrame([(1, "a", "%Lost%", None, None), (2, "b", "%Wall%", None, None)], "pos int, name string, pattern string, parent_pattern string, brand_tokens array<string>")
    sources = spark.createDataFrame([], "id long, company string, enabled boolean, board string")
    prev = spark.createDataFrame([("%Lost%", "healthy", 2), ("%Wall%", "login_wall", 3)], "pattern string, state string, attempts int")
    got = {r["pos"]: (r["state"], r["attempts"]) for r in coverage.gap_census(jobs(spark, [("Other", "t", "s")]), sources, dim, prev, NOW).collect()}
    assert got == {1: ("unknown", 2), 2: ("login_wall", 3)}


def test_payload_keys_go_at_any_depth(spark):
    p = json.dumps({"diagnostics": {"source": "pdf", "Job-Title": "x", "list": [{"e mail": 1, "EMAIL": 2, "ok": True}]}, "user_email": "a@b"})
    df = spark.createDataFrame([(1, " Résumé Upload ", p), (2, "x" * 65, "{}"), (3, " ", "{}"), (4, "e", "[1]"), (5, "e", "not json"), (6, "e", None), (7, "e", json.dumps({"a": "y" * 5000}))], "id long, event string, payload string")
    got = {r["id"]: (r["event"], r["payload"]) for r in validate.clean_events(df).collect()}
    assert json.loads(got[1][1]) == {"diagnostics": {"source": "pdf", "list": [{"e mail": 1, "ok": True}]}} and got[1][0] == "Résumé Upload"
    assert {i: p for i, (_, p) in got.items() if i > 1} == {4: "{}", 5: "{}", 6: "{}", 7: "{}"}
    assert {r["id"]: r["reason"] for r in validate.judge_events(df).where("reason is not null").collect()} == {2: "event_too_long", 3: "event_missing"}


def test_consensus_of_open_and_backward_ranges(spark):
    kind = "id long, company_id long, season string, batch string, event string, month_start int, month_end int, publisher string, official boolean"
    rows = [(1, 1, "s", "b", "e", 8, None, "p1", False), (2, 1, "s", "b", "e", 9, 7, "p2", False), (3, 2, "s", "b", "e", 8, 8, "p1", False), (4, 2, "s", "b", "e", 7, 9, "p1", True), (5, 3, "s", "b", "e", 1, 2, "p", False)]
    claims = spark.createDataFrame(rows, kind)
    got = {r["company_id"]: (r["month_start"], r["month_end"], r["n_pub"], r["status"]) for r in campus.cycle_consensus(claims).collect()}
    assert got == {1: (8, 8, 1, "draft"), 2: (8, 8, 1, "verified"), 3: (1, 2, 1, "draft")}
    prior = spark.createDataFrame([(2, "s", "b", "e", "verified"), (3, "s", "b", "e", "draft")], "company_id long, season string, batch string, event string, status string")
    assert [r["company_id"] for r in campus.cycle_consensus(claims, prior).collect()] == [1]


def test_only_public_claims_of_a_writing_run_retire(spark):
    items = spark.createDataFrame([(1, 1, "public_web", "active", "2001-01-01"), (2, 1, "first_party", "active", "2001-01-01"), (3, 1, "public_web", "active", "2001-03-01"), (4, 2, "public_web", "active", "2001-01-01"), (5, 1, "public_web", "draft", "2001-01-01")],
                                  "id long, company_id long, origin string, status string, day string").withColumn("last_verified_at", F.col("day").cast("timestamp"))
    runs = spark.createDataFrame([(1, "2001-02-01", True), (2, "2001-02-01", False)], "company_id long, day string, wrote_any boolean").withColumn("run_start", F.col("day").cast("timestamp"))
    got = {r["id"]: r["status"] for r in insights.retire_generation(items, runs).collect()}
    assert got == {1: "retired", 2: "active", 3: "active", 4: "active", 5: "draft"}


def test_entities(one):
    assert one(lambda: T.unescape_html("s"), s="caf&eacute; &#8211; &#x4e2d;&amp;#25991; &amp;lt;b&amp;gt; &bogus; &#0; a&nbsp;b & c") == "café – 中文 <b> &bogus; &#0; a b & c"


def test_untried_ledger_rows_keep_their_times(spark):
    prev = spark.createDataFrame([("a", "s", 1, {"k": "1"}, "2001-01-01", "why"), ("b", "s", 1, {"k": "1"}, "2001-01-01", "why")], "company string, state string, attempts int, evidence map<string,string>, last_attempt_at string, fail_reason string").withColumn("last_attempt_at", F.col("last_attempt_at").cast("timestamp"))
    res = spark.createDataFrame([("b", "t", {"k": "2"}, None)], "company string, state string, evidence map<string,string>, fail_reason string")
    got = {r["company"]: (str(r["last_attempt_at"])[:10], r["fail_reason"]) for r in ingest.merge_gap_attempts(prev, res, NOW).collect()}
    assert got == {"a": ("2001-01-01", "why"), "b": ("2001-08-01", None)}


def test_detail_links_of_platforms(one):
    from vacancylake.functions import urls as U
    cases = [("https://jobs.apple.com/en-us/details/1/x", "apple", True), ("https://jobs.apple.com/de-de/details/1/x", "apple", False), ("https://talent.baidu.com/jobs/detail/INTERN/7", "baidu", True),
             ("https://zhaopin.jd.com/web/job-info-detail?requementId=12", "jd", True), ("https://zhaopin.jd.com/web/job-info-detail?requementId=a", "jd", False), ("https://boards.greenhouse.io/a/jobs/1", "greenhouse", True),
             ("https://app.mokahr.com/apply/acme#/job/1", "moka", True), ("https://app.mokahr.com/apply/acme", "moka", False), ("https://jobs.lever.co/a/b", "lever", True), ("ftp://jobs.lever.co/a/b", "lever", False),
             ("https://a.cn/position/12", "generic_official_detail", True), ("https://a.cn/positions/", "generic_official_detail", False), ("https://a.cn/job/x?page=2", "generic_official_detail", False),
             ("https://a.cn/job/x?page=2&jobId=3", "generic_official_detail", True), ("https://a.cn/%E6%8B%9B%E8%81%98/1", "generic_official_detail", True), ("https://a.cn/", "generic_official_detail", False), (None, "lever", False), ("https://a.cn/job/1", "other", False)]
    assert [one(lambda: U.is_detail_url("u", "p"), u=u, p=p) for u, p, _ in cases] == [want for _, _, want in cases]
