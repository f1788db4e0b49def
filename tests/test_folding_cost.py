"""Texts are lower-cased and read once, with the same results."""
from pyspark.sql import functions as F

from vacancylake.functions import dates as D, resume as RS, text as T, urls as U
from vacancylake.operators import search as S

from test_text_cost import plan_of

NOW = "2001-08-02 00:00:00"


def texts(spark, values):
    return spark.createDataFrame([(i, t) for i, t in enumerate(values)], "i int, t string")


def read(rows, value):
    return [r.v for r in rows.select("i", value.alias("v")).orderBy("i").collect()]


def test_a_resume_is_folded_once(spark):
    rows = texts(spark, ["求职意向：bi\t岗位\r\nＳkills Python 技能 sql power bi\n\n北京 某大学 INTERN  rag", "plain", None, "Aİ x", "熟练 python"])
    assert plan_of(rows.select(RS.parse_resume("t").alias("p"))).count("lower(") < 10
    p = read(rows, RS.parse_resume("t"))
    assert (p[0].headline, p[0].target_roles, p[0].target_locations, p[0].stage) == ("bi 岗位", ["数据分析"], ["北京"], "实习")
    assert set(p[0].skills) >= {"Python", "SQL", "Power BI", "RAG"}
    assert p[1].headline == "plain" and p[2].headline == RS.NO_HEADLINE and p[2].skills == []
    assert p[3].industries == []  # the dotted capital is no letter of the pattern
    assert p[4].skills[0] == "Python"


def test_deadline_dates_are_read_once(spark):
    rows = texts(spark, ["2001-08-10", "8月20日截止", "2001-08-15 至 2001-09-15", "长期有效 2001-08-10", "", None, "6月1日", "2001年9月1日, 9月1日", "月 日 7"])
    assert plan_of(rows.select(D.parse_deadline("t", NOW).alias("p"))).count("regexp_extract_all") == 2
    got = read(rows, D.parse_deadline("t", NOW))
    assert [g and (str(g.date), g.confidence) for g in got] == [("2001-08-10", "high"), ("2001-08-20", "medium"), None, None, None, None, ("2002-06-01", "medium"), ("2001-09-01", "high"), None]


def test_education_clauses_are_ranked_once(spark):
    rows = texts(spark, ["本科及以上，硕士优先", "硕士 或 博 士", "学历不限", "", None, "nice", "Bachelor or master preferred", "master preferred"])
    assert plan_of(rows.select(T.education_match("t", F.lit("本科")).alias("v"))).count("split(") == 1
    assert read(rows, T.education_match("t", F.lit("本科"))) == ["pass", "reject", "pass", "degrade", "degrade", "degrade", "pass", "pass"]
    assert read(rows, T.education_floor("t")) == [4, 5, 0, None, None, None, 4, None]


def test_a_query_is_cleaned_once_per_link(spark):
    rows = texts(spark, ["https://x/a/?utm_source=1", "https://x/a?id=1&spm=2", "https://x/a//", "https://x/a?GCLID=1&page=2", "https://x/a/#t?spm=1", "", None, "https://x/a?", " https://x/?b=1 "])
    assert plan_of(rows.select(U.canonical_url("t").alias("v"))).count("utm_") == 1
    assert read(rows, U.canonical_url("t")) == ["https://x/a", "https://x/a?id=1", "https://x/a", "https://x/a?page=2", "https://x/a/#t?spm=1", "", None, "https://x/a", "https://x?b=1"]


def test_columns_are_folded_by_themselves(spark):
    rows = spark.createDataFrame([("产品 ÄB", "X", None, "", "New", "1K"), ("a", None, "ΑΣ", "b", "ΣΑ Grad", None)], "title string, company string, location string, job_type string, summary string, salary_text string")
    assert [r.h for r in rows.select(S.haystack(*S.SEARCHED).alias("h")).collect()] == ["产品 äb x new 1k", "a ας b σα grad"]
    assert "lower(concat_ws" not in plan_of(rows.select(S.haystack(*S.SEARCHED).alias("h")))
    for value in (T.sponsorship("title", "summary"), T.min_years("title", "summary"), T.grad_class("title", "job_type", "summary"), S.recruitment_prefilter("校招", url="title")):
        assert "lower(concat" not in plan_of(rows.select(value.alias("v")))


def test_text_dates_and_experience_fold_a_text_once(spark):
    rows = texts(spark, ["截止 2001/9/1", "Rolling", "DEADLINE: 2001年9月1", None, "3-5 Years", "7+ YEARS", "Senior x", "3 to 5 years", "year 3"])
    assert plan_of(rows.select(D.deadline_text("t").alias("v"))).count("lower(") == 1
    assert plan_of(rows.select(T.experience_text("t").alias("v"))).count("lower(") == 1
    assert read(rows, D.deadline_text("t")) == ["2001-9-1", "长期有效", "2001-9-1", None, None, None, None, None, None]
    assert read(rows, T.experience_text("t")) == [None, None, None, None, "3-5年", "7年+", "5年+", "3-5年", None]
