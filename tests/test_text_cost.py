"""Costly columns are computed once per row; blanks are folded the same way in every text."""
from pyspark.sql import functions as F

from vacancylake.functions import base as B, keywords as KW, text as T
from vacancylake.operators import search as S

POSTING = "id string, title string, company string, location string, job_type string, summary string, salary_text string, jd_url string, status string, job_scope string, country_code string, education string, experience string, sponsorship_signal string, first_seen_at timestamp"


def postings(spark):
    rows = [("a", "产品经理", "X", "深圳", None, "负责产品", "1-2K", "https://x.example/1", "active", "domestic", "CN", "本科", None, "none", None),
            ("b", "招聘", "Y", "", "社招", "HR 与 产品 经理, 3年 工作经验", None, "https://x.example/2", "active", "domestic", "CN", None, None, "none", None),
            ("c", None, None, None, None, None, None, None, "active", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, POSTING)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_function_and_vocabulary_are_read_once_per_posting(spark):
    found = S.scan_search(postings(spark), S.Filters(keyword="产品 运营", city="深圳"), "2001-08-02")
    plan = plan_of(found)
    assert plan.count("产品负责人") == 2  # the rule over the title and the rule over the text
    assert plan.count("ArrowEvalPython") == 1
    assert [(r.id, r.tier) for r in found.orderBy("id").collect()] == [("a", "exact")]


def test_experience_is_read_once_per_posting(spark):
    plan = plan_of(S.match_filters(postings(spark), S.Filters(job_type="社招", city="深圳", education="本科"), "2001-08-02").select("id", "tier", "degraded"))
    assert plan.count("(?!级)") == plan_of(postings(spark).select(T.asks_experience("title", "experience", "summary").alias("s"))).count("(?!级)")


def test_request_features_are_constants_equal_to_the_columns(spark):
    groups = KW.vocabulary(None, True)
    words = ["后端", "运营", "product manager", "hr", "zzz", ""]
    got = spark.range(1).select(*[q.alias(f"q{i}") for i, q in enumerate(KW.request_features(spark, words, groups, True))])
    want = spark.range(1).select(*[KW.query_features(F.lit(w), groups, True).alias(f"q{i}") for i, w in enumerate(words)])
    assert got.collect() == want.collect()
    assert "lambda" not in plan_of(got)
    terms = F.array(F.lit("product manager"), F.lit("算法"))
    assert spark.range(1).select(KW.request_clauses(spark, terms).alias("c")).collect() == spark.range(1).select(KW.clauses_of(terms).alias("c")).collect()


def test_blanks_of_any_kind(spark):
    texts = [None, "", " ", " "] + [f"{e}{b}x{b}{b} y{b} z{b}" for b in B.BLANKS for e in ("", "é", "‘中")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("t", B.squeeze("t").alias("one"), B.strip_spaces("t").alias("none")).collect()
    for t, one, none in got:
        if t is None:
            assert (one, none) == (None, None)
        else:
            spaced = "".join(" " if ch in B.BLANKS else ch for ch in t)
            assert one == " ".join(w for w in spaced.split(" ") if w) and none == spaced.replace(" ", "")


def test_years_near_a_word_are_found_without_looking_back_everywhere(spark):
    texts = ["经验 3年", "经验丰富, 团队 12-15年 以上", "5 年以上经验", "2 年级 经验", "2001年 建立", "1年 x 3年 工作经验", "no experience 7 years", "ye ars 3", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.y for r in rows.orderBy("i").select(T.min_years("t").alias("y")).collect()] == [3, 12, 5, None, None, 1, 7, None, None]
    # a number is tested before the words around it
    assert T.YEARS_NEAR.startswith("(?=(?:[0-9]") or T.YEARS_NEAR.startswith(r"(?=(?:\d")


def test_short_words_are_whole_runs(spark):
    groups = [("f", ["hr", "c++", "bi", "product manager"]), ("g", ["产品", "ai"])]
    rows = spark.createDataFrame([("hr", "three bi-lingual"), ("product", "manager of chrome"), ("", "c++ and AI2"), ("产品ai", ""), ("c+", "+ x")], "title string, summary string")
    j = rows.select("title", "summary", *[F.lit(None).cast("string").alias(c) for c in ("company", "location", "job_type", "salary_text")])
    got = KW.with_posting_features(j, groups).select("kw.title_groups", "kw.body_groups", "kw.all_groups").collect()
    assert [tuple(map(list, r)) for r in got] == [([0], [0], [0]), ([], [], [0]), ([], [0], [0]), ([1], [], [1]), ([], [], [])]
