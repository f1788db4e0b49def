"""Text columns seek words before patterns and read a value once: same answers as the patterns alone."""
from pyspark.sql import functions as F

from vacancylake.functions import base as B, fixed as V, geo as G, text as T

TEXTS = ["Senior staff", "seniority staffing", "leading the lead", "校招2027届", "class of 2026 and GRADUATE 2031", "Class  Of 2024", "2025年 秋招", "应届 2023", "2024实习生", "27届", "no digits class campus",
         "Master's or Ph.D", "ms items", "本科 学历不限", "associate's degree", "B.A. preferred", "<p>经验不限</p>", "No Experience", "3-5 年 经验", "<script>x</script> a &amp;lt; b", "a < b", "", "entry-level role", "university  graduate", None]


def test_alternatives_of_a_group_are_guarded_each(spark):
    rule = r"\b(?:senior|staff|lead)\b"
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(F.lower("t").alias("t"))
    plan = df.where(B.find("t", rule))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(") >= 3, plan  # each word is sought before its pattern
    for pattern in (rule, r"\b(?:university\s+graduate|entry[-\s]?level)\b", r"\b(?:2027|staff)\b", "(?:届|招)"):
        for edges in (B.ascii_edges, B.unicode_edges):
            assert df.where(~B.find("t", pattern, edges).eqNullSafe(F.col("t").rlike(edges(pattern)))).count() == 0, pattern


def test_class_and_level_equal_the_patterns_alone(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    s = F.coalesce("t", F.lit(""))
    found = F.transform(F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in V.GRAD_CLASS_PATTERNS]), lambda y: y.cast("int"))
    years = F.filter(F.transform(found, lambda y: F.when(y < 100, y + 2000).otherwise(y)), lambda y: y.between(*V.GRAD_CLASS_RANGE))
    assert df.where(~T.grad_class("t", None, None).eqNullSafe(F.array_max(years))).count() == 0
    bare = B.squeeze(F.regexp_replace(s, r"<[^>]+>", " "))
    assert df.where(~T.plain("t").eqNullSafe(bare)).count() == 0
    t = F.lower(B.strip_spaces(bare))
    chain = F.when(bare == "", F.lit(None))
    for label, _rank, pattern in V.EDUCATION_LEVELS:
        chain = chain.when(t.rlike(pattern), label)
    assert df.where(~T.education_level("t").eqNullSafe(chain.when(bare.contains("学历不限"), "不限"))).count() == 0


def test_a_place_is_squeezed_once(spark):
    df = spark.createDataFrame([("  北京 市",), ("beijing  office",), ("",), (None,), ("n/a",), ("Nowhere　Town",)], "c string")
    assert str(G.clean_location("c")._jc.toString()).count("replace(c,") <= 2  # not once per alias
    assert [r[0] for r in df.select(G.clean_location("c")).collect()][3] is None
