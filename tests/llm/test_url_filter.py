from vacancylake.llm import url_filter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def judged(spark, urls, listed=()):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, RULES, keys).collect()}


def test_rules_and_list(spark):
    urls = ["https://A.Example.NET/en/x?q#f", "http://example.net/EN/", "http://notexample.com/de/1", "http://x.example.com/de/1", "https://www.bad.test/a.html#t", "bad.test/a",
            None, "", "http://", "http://net", "http://net/", "x://y://org/fr/", "http://org/fr/?u=http://net/"]
    got = judged(spark, urls, ["bad.test/a", "bad.test/a", None])
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/EN/", "net/", "block")
    assert got[2] == ("notexample.com", "/de/1", None, "allow")
    assert got[3] == ("x.example.com", "/de/1", "example.com/de/", "block")
    assert got[4] == ("www.bad.test", "/a.html", None, "block")
    assert got[5] == got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("net", "", None, "allow") and got[10] == ("net", "/", "net/", "block")
    assert got[11] == ("y:", "//org/fr/", None, "allow") and got[12][2:] == ("org/fr/", "allow")


def test_empty_repeated_and_clashing(spark):
    assert judged(spark, []) == {}
    df = spark.createDataFrame([(1, "http://a.net/x" + "y" * 20000, "h")] * 3 + [(None, None, "h")], "page_id long, url string, host string")
    rows = url_filter.judge(df, RULES, spark.createDataFrame([], "key string")).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in rows) == [(0, "allow"), (1, "block"), (1, "block"), (1, "block")]


def test_filter_loses_no_key_and_passes_few_others(spark):
    keys = spark.range(3000).selectExpr("concat('u:', id) as key")
    blocks = 3000 // url_filter.KEYS_PER_BLOCK + 1
    table = url_filter.bloom(keys, blocks)
    assert url_filter.possible_hits(keys, table, blocks).count() == 3000
    assert url_filter.possible_hits(spark.range(20000).selectExpr("concat('w:', id) as key"), table, blocks).count() < 200


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    plan = url_filter.judge(pages, RULES, spark.createDataFrame([("a",)], "key string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
