"""Life-cycle invariants, keyword tiers and joins on small fixtures."""
import itertools

from pyspark.sql import functions as F

from vacancylake.functions import keywords as KW
from vacancylake.operators import core as C, ingest as I, search as S

NOW = "2026-08-01 00:00:00"
STORE = "id string, source_id string, canonical_jd_url string, jd_url string, title string, summary string, status string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, enrich_fail_count int"


def store(spark):
    rows = [("a", "1", "u1", "u1", "A", "kept", "active"), ("b", "1", "u2", "u2", "B", "x", "removed"), ("c", "1", "u3", "u3", "C", "x", "expired")]
    return spark.createDataFrame([(*r, None, None, None, 0) for r in rows], STORE)


def batch(spark):
    rows = [("1", "u1", "A1", "", 1), ("1", "u1", "A2", None, 2), ("1", "u2", "B2", "y", 1), ("1", "u3", "C2", "y", 1), ("1", "u4", "D", "z", 1)]
    return spark.createDataFrame([(s, u, u, t, b, None, q) for s, u, t, b, q in rows], "source_id string, canonical_jd_url string, jd_url string, title string, summary string, posted_at timestamp, arrived_seq int")


def test_upsert_rules_and_idempotence(spark):
    jobs, events, counts = I.upsert_jobs(store(spark), batch(spark), NOW)
    got = {r["canonical_jd_url"]: r for r in jobs.collect()}
    assert got["u1"]["title"] == "A2" and got["u1"]["summary"] == "kept"
    assert got["u2"]["status"] == "active" and got["u3"]["status"] == "expired" and got["u4"]["status"] == "active"
    kinds = sorted(r["event_type"] for r in events.collect())
    assert kinds == ["FIRST_SEEN", "REAPPEARED"]
    assert tuple(counts.first()) == (1, 3)
    again, events2, _ = I.upsert_jobs(jobs, batch(spark), NOW)
    assert sorted(map(str, again.collect())) == sorted(map(str, jobs.select(*again.columns).collect()))
    assert events2.count() == 0


def test_upsert_keeps_one_active_row_per_url(spark):
    jobs, _e, _c = I.upsert_jobs(store(spark), batch(spark), NOW)
    assert jobs.where("status = 'active'").groupBy("canonical_jd_url").count().where("count > 1").count() == 0


def _tier(spark, title, summary, query):
    gs = KW.vocabulary()
    row = spark.createDataFrame([(title, summary)], "title string, summary string")
    for c in ("company", "location", "job_type", "salary_text"):
        row = row.withColumn(c, F.lit(None).cast("string"))
    f = KW.with_posting_features(row, gs).withColumn("q", KW.query_features(F.lit(query), gs))
    return f.select(KW.keyword_tier("q", "kw").alias("t")).first()["t"]


def test_keyword_tiers(spark):
    assert _tier(spark, "高级软件工程师", None, "后端") == "related"
    assert _tier(spark, "前端开发工程师", None, "后端") is None
    assert _tier(spark, "Java 后端开发", None, "后端") == "exact"
    assert _tier(spark, "算法工程师", "与产品团队合作", "pm") is None
    assert _tier(spark, "anything", None, "") == "exact"


def test_contains_join_equals_brute_force(spark):
    texts = ["Alpha One", "alphabet", "beta", "中国银行北京分行", "a", "", "one beta"]
    needles = ["alpha", "ONE", "a", "银行", "beta", "zz", ""]
    got = C.contains_join(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n")
    want = {(t, n) for t, n in itertools.product(texts, needles) if n and n.lower() in t.lower()}
    rows = [(r["t"], r["n"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_match_patterns_equals_brute_force(spark):
    texts = spark.createDataFrame([("Acme Corp",), ("Beta",), ("Ac",)], "t string")
    pats = spark.createDataFrame([("%acme%",), ("b_ta",), ("%",), ("__",), ("a%p",)], "p string")
    got = {(r["t"], r["p"]) for r in C.match_patterns(pats, "p", texts, "t").collect()}
    want = {(r["t"], r["p"]) for r in texts.join(pats, F.expr("t ilike p")).collect()}
    assert got == want


def test_overlap_join_equals_brute_force(spark):
    rows = [(i, i % 2, s, e) for i, (s, e) in enumerate([(1, 3), (2, 2), (3, 6), (7, 9), (9, 12), (1, 12), (5, 5)])]
    df = spark.createDataFrame(rows, "id int, k int, s int, e int")
    got = sorted((r["id_a"], r["id_b"]) for r in C.overlapping(df, ["k"], "s", "e", "id").collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and max(a[2], b[2]) <= min(a[3], b[3]))
    assert got == want


def test_token_search_needs_all_groups(spark):
    docs = spark.createDataFrame([("1", ["产品", "北京"]), ("2", ["产品", "上海"]), ("3", ["北京"])], "id string, search_doc array<string>")
    cl = spark.createDataFrame([("q", 0, ["产品"]), ("q", 0, ["算法"]), ("q", 1, ["北京"])], "query_id string, grp int, tokens array<string>")
    assert [tuple(r) for r in S.token_search(docs, cl).collect()] == [("q", "1")]


def test_weighted_draw_fills_from_other_tiers(spark):
    df = spark.createDataFrame([("u", 0, i) for i in range(3)] + [("u", 2, i + 10) for i in range(20)], "u string, tier int, id int")
    from vacancylake.operators.feed import weight_of
    got = C.weighted_round_robin(df, ["u"], "tier", [F.col("id")], weight_of("tier"), 10)
    assert got.count() == 10 and got.where("tier = 0").count() == 3


def test_absence_guard(spark):
    jobs = spark.createDataFrame([(str(i), "s", "active", "2026-01-01" if i < 6 else "2026-08-01") for i in range(10)], "id string, source_id string, status string, last_seen_at string").withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp"))
    runs = spark.createDataFrame([("s", True, "2026-07-01")], "source_id string, coverage_complete boolean, cutoff string").withColumn("cutoff", F.col("cutoff").cast("timestamp"))
    assert I.absence_plan(jobs, runs).first()["action"] == "skip"
    assert I.absence_sweep(jobs, runs, NOW)[0].where("status = 'expired'").count() == 0
