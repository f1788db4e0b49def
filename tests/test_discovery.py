import json

from pyspark.sql import functions as F

from vacancylake import schemas
from vacancylake.functions import career as CR, facts as FA, pages as PG, resume as RS
from vacancylake.operators import campus as CA, discovery as D, insights as IN
from vacancylake.sources.buckets import JobStore


def classes(spark, *urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").coalesce(1)
    rows = df.select("i", PG.classify_link("url").alias("f"), "url").select("i", "f", PG.worth_recording("url", F.col("f")).alias("rec"), PG.china_signal("url", F.col("f")).alias("cn")).orderBy("i").collect()
    return [dict(r["f"].asDict(), rec=r["rec"], cn=r["cn"]) for r in rows]


def test_link_classes(spark):
    gh, lever, leet, unknown, tencent, ashby, shlab, shlist, byte, bytedetail, wy, linked, moka, zhihu, thu, none, blank, feishu, plain = classes(
        spark, "https://job-boards.greenhouse.io/anthropic/jobs/5076109008", "https://jobs.lever.co/acme/abc-123", "https://leetcode.cn/company/chinaclear/jobs/EXPERIENCED/",
        "https://example.com/careers/machine-learning-engineer", "https://careers.tencent.com/", "https://jobs.ashbyhq.com/acme", "https://www.shlab.org.cn/joinus/detail/7612950926287391027?mode=campus",
        "https://www.shlab.org.cn/joinus", "https://jobs.bytedance.com/campus/position", "https://jobs.bytedance.com/campus/position/7631837782784968965/detail", "https://hr.163.com/",
        "https://www.linkedin.com/jobs/view/123", "https://app.mokahr.com/campus_apply/tencent/123#/jobs", "https://zhuanlan.zhihu.com/p/123456", "https://career.tsinghua.edu.cn/jobfair/jobs/123?company=Acme",
        None, "   ", "https://nio.jobs.feishu.cn/index", "https://www.example.org/products")
    assert (gh["platform"], gh["confidence"], gh["parser"], gh["slug"], gh["keywords"], gh["signal"]) == ("greenhouse", 0.95, "greenhouse", "anthropic", ["jobs"], "official_ats:greenhouse")
    assert (lever["company"], lever["confidence"], lever["reason"]) == ("acme", 0.95, "Supported Lever job detail URL")
    assert leet["rejected"] and leet["source_type"] == "third_party_job_board" and not leet["rec"]
    assert (unknown["platform"], unknown["confidence"], unknown["company"], unknown["parser"], unknown["keywords"]) == ("official_careers", 0.65, "example", None, ["careers"])
    assert tencent["platform"] == "official_careers" and tencent["parser"] is None and tencent["rec"] and tencent["cn"]
    assert ashby["platform"] == "ashby" and ashby["parser"] is None and ashby["rec"] and not ashby["cn"]
    assert (shlab["source_type"], shlab["company"], shlab["parser"]) == ("official_campus", "shlab", "generic_official_detail") and "joinus" in shlab["keywords"]
    assert shlist["parser"] is None
    assert (byte["company"], byte["source_type"], byte["keywords"], byte["parser"]) == ("字节跳动", "official_campus", ["campus", "jobs"], None) and bytedetail["parser"] == "generic_official_detail"
    assert (wy["company"], wy["reject_reason"], wy["signal"]) == ("网易", None, "known_china_official_source")
    assert linked["rejected"] and zhihu["reject_reason"] == "Blocked content repost or SEO aggregation page"
    assert (moka["platform"], moka["stored_platform"], moka["slug"], moka["keywords"], moka["source_type"]) == ("moka", "official_careers", "tencent", ["campus_apply", "jobs"], "official_campus")
    assert (thu["platform"], thu["reject_reason"]) == ("campus_repost", "Blocked university career-center repost page")
    assert none["rejected"] and blank["reason"] == "Invalid URL" and none["company"] is None
    assert feishu["platform"] == "feishu_recruit" and plain["platform"] == "unknown" and not plain["rec"]


def test_known_sites_are_a_parameter(spark):
    df = spark.createDataFrame([("https://a.jobs.acme.test/x",), ("https://zhihu.com/p/1",)], "url string")
    got = df.select(PG.classify_link("url", [("Acme", ["acme.test"]), ("Z", ["zhihu.com"])]).alias("f")).select("f.company", "f.signal").collect()
    assert [tuple(r) for r in got] == [("Acme", "known_china_official_source"), ("Z", "known_china_official_source")]
    assert df.select(PG.classify_link("url", []).alias("f")).select("f.rejected").collect()[1][0]


def test_page_platform(spark):
    rows = [("https://app.mokahr.com/x", "", "moka", "moka"), ("https://a.hotjob.cn/wt/x", None, "wt", "wt"), ("https://x.test", '<a href="https://acme.dayee.com/a">', "dayee", None),
            ("https://x.test", "see acme.zhiye.com now", "beisen", "beisen"), ("https://x.test", "fetch('/wday/cxs/a')", "workday", "workday"), ("https://career5.successfactors.eu/a", "", "successfactors", "successfactors"),
            ("https://x.test", "notmokahr.com.evil", "unknown", None), (None, None, "unknown", None), ("https://mokahr.com.evil.test/", "", "unknown", None)]
    df = spark.createDataFrame(rows, "url string, html string, platform string, adapter string").coalesce(1)
    for r in df.select(PG.page_platform("url", "html").alias("p"), "*").collect():
        assert tuple(r["p"]) == (r["platform"], r["adapter"]), r


def test_page_state_identity_and_shape(spark):
    login = '<input class=a type="password"> 登录'
    pages = [(403, "", "anti_bot"), (200, "Access Denied", "anti_bot"), (None, "akamai bot challenge", "anti_bot"), (200, None, None), (200, login, "login_wall"), (200, login + " job-detail", None),
             (200, '<a href="x.pdf?v=1">招聘公告</a>', "no_stable_jd"), (200, "<div id='app'></div>", "unknown_spa")]
    for r in spark.createDataFrame(pages, "s int, h string, want string").coalesce(1).select(PG.page_state("s", "h").alias("got"), "*").collect():
        assert r["got"] == r["want"], r
    owners = [("腾讯科技有限公司", "https://x.test", "<title>腾讯科技有限公司 招聘</title>", True, "page_company_match:full"), ("腾讯科技有限公司", "https://x.test", "<title>加入腾讯</title>", True, "page_company_match:core"),
              ("Acme Holdings Ltd", "https://jobs.acme.test", "<body><script>acme</script>We are ＡＣＭＥ.</body>", True, "page_company_match:core+host_related"),
              ("Acme", "https://x.test", "<script>Acme</script>" + "x" * 3001 + " Acme", False, "page_company_not_found"), (" ", None, None, True, "company_not_provided")]
    for r in spark.createDataFrame(owners, "c string, u string, h string, ok boolean, why string").coalesce(1).select(PG.page_identity("c", "u", "h").alias("got"), "*").collect():
        assert tuple(r["got"]) == (r["ok"], r["why"]), r
    shapes = [("<a class='position-list'>", True), ("<p>jobs</p><b>careers</b>", True), ("<script>jobs careers</script>jobs", False), (None, False)]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(shapes, "h string, want boolean").coalesce(1).select(PG.looks_like_recruiting("h").alias("got"), "want").collect())


def test_resume(spark):
    text = "张三\r\n求职意向：数据分析  实习\n技能：Python、SQL，熟练 Tableau\n2023 某大学 本科\n在上海某基金公司实习，负责用户研究\n数据分析项目"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(RS.parse_resume("t").alias("p")).select("p", RS.preferences("p").alias("w"), RS.english_profile("p").alias("e")).collect()
    p = row[0]["p"]
    assert p["headline"] == "数据分析 实习" and p["target_roles"] == ["数据分析"] and p["target_locations"] == ["上海"] and p["stage"] == "实习"
    # one-letter terms are found inside words; the explicit skill line comes first, the role's own word is no skill
    assert p["skills"][:4] == ["Python", "SQL", "R", "Tableau"] or p["skills"][:3] == ["Python", "SQL", "Tableau"]
    assert "数据分析" not in p["skills"] and p["industries"] == ["金融"] and p["education"] == ["2023 某大学 本科"] and len(p["experience"]) == 3
    assert row[0]["w"]["target_roles"] == ["数据分析"] and row[0]["e"]["has_en_resume"]
    assert row[1]["p"]["headline"] == RS.NO_HEADLINE and row[1]["p"]["skills"] == [] and row[1]["p"]["stage"] == "未判断"
    long = spark.createDataFrame([("产品经理 " * 200_000,)], "t string").select(RS.parse_resume("t").alias("p")).first()["p"]
    assert len(long["headline"]) == RS.HEADLINE_CHARS and long["target_roles"] == ["产品经理"]


def test_windows(spark):
    rows = [("8-10 月", [8, 9, 10], False, False, "open"), ("5–7月 HC 偏紧", [5, 6, 7], False, True, "unknown"), ("8月冻结", [8], False, True, "closed"), ("全年滚动", [], True, False, "rolling"),
            ("3 到 4月、9 月", [3, 4, 9], False, False, "closed"), ("11-2月", list(range(2, 12)), False, False, "open"), ("13月", [], False, False, "unknown"), (None, [], False, False, "unknown"), ("2024 秋招", [], False, False, "unknown")]
    df = spark.createDataFrame(rows, "w string, months array<int>, rolling boolean, negative boolean, status string").coalesce(1)
    for r in df.select(CR.window_months("w").alias("m"), CR.window_status("w", 8).alias("s"), "*").collect():
        assert (r["m"]["months"], r["m"]["rolling"], r["m"]["negative"], r["s"]) == (r["months"], r["rolling"], r["negative"], r["status"]), r


def test_timing_takes_the_best_and_first(spark):
    df = spark.createDataFrame([(["1月", "全年", "8月", "7-9月"],), ([],), (None,), ([None, "1月", "2月"],)], "w array<string>")
    got = [tuple(r["t"]) for r in df.select(CR.timing_status("w", 8).alias("t")).collect()]
    assert got == [("open", "招聘窗口期", "8月"), ("unknown", "时机未知", None), ("unknown", "时机未知", None), ("closed", "可能非窗口期", "1月")]


def test_career_path_without_items(spark):
    wanted = spark.createDataFrame([(1, 0, "a", None, 2), (1, 1, "b", "B", None), (2, 0, "a", "A", 0)], "user_id long, pos int, company string, display_name string, job_count long")
    none = spark.createDataFrame([], "company string, dimension string, pos long, time_window string, title string, content string")
    rows = IN.career_path(wanted, none, "2024-08-01").orderBy("user_id", "rank").collect()
    assert [(r["user_id"], r["company"], r["status"], r["reasons"]) for r in rows] == [(1, "a", "unknown", ["时机未知", "2 个在招岗位"]), (1, "b", "unknown", ["时机未知"]), (2, "a", "unknown", ["时机未知"])]
    assert IN.career_notes(wanted, none).count() == 0


def test_audit_reads_nested_and_broken_json(spark):
    providers = [{"name": "p", "diagnostics": {"queries": [{"query": "q1", "results": [{"url": f"https://jobs.lever.co/a/{i}", "title": None} for i in range(12)]}, {"query": "q2"}]}},
                 {"provider_name": "own", "query": "q3", "results": [{"url": None, "provider_query": "other"}]}]
    runs = spark.createDataFrame([(1, json.dumps(providers)), (2, "broken"), (3, None), (4, "[]")], "run_id int, providers string")
    rows = D.results_audit(runs).select("run_id", "provider_name", "query", "url", "found.platform").collect()
    assert len(rows) == 11 and {r["query"] for r in rows} == {"q1", "other"} and [r["platform"] for r in rows if r["url"] == ""] == ["unknown"]
    reasons = D.candidate_rows(D.results_audit(runs), "pending").select("reason").collect()
    assert all(json.loads(r["reason"])["status"] == "pending" for r in reasons)


def test_merged_reason(spark):
    df = spark.createDataFrame([('{"a": 1, "status": "x"}',), ("plain",), ("[1]",), (None,), ('{"broken',)], "r string")
    got = [json.loads(r[0]) for r in df.select(D.merged_reason("r", "parsed", "why", "t")).collect()]
    new = {"status": "parsed", "status_update": "why", "status_updated_at": "t"}
    assert got == [{"a": 1, **new}, {"previous_reason": "plain", **new}, {"previous_reason": "[1]", **new}, new, {"previous_reason": '{"broken', **new}]


def test_targets_first_wins(spark):
    rows = [(0, 0, "Acme Inc", None, ["a b"], None), (0, 1, "Acme", "", [" acme "], "x"), (0, 2, "acme", None, ["z"], None), (0, 3, None, None, ["n"], None), (0, 4, "Known Co", None, ["k"], None), (1, 0, "acme", "名", ["1", "2", "3", "4", "5"], None)]
    got = D.clean_targets(spark.createDataFrame(rows, "batch int, pos int, company string, cn string, slugs array<string>, industry string"), spark.createDataFrame([("Known Co",)], "company string"))
    assert [(r["batch"], r["company"], r["cn"], r["slugs"]) for r in got.orderBy("batch", "pos").collect()] == [(0, "Acme", "Acme", ["acme"]), (1, "acme", "名", ["1", "2", "3", "4"])]


def test_expansion_keeps_first_address(spark):
    targets = spark.createDataFrame([(0, "Takeda", ["t", "u"], ["lever", "none"], "i"), (1, "Other", ["t"], ["lever"], "j"), (2, "Third", [], ["lever"], "j"), (3, "Fourth", ["f"], None, "j")], "pos int, company string, slugs array<string>, ats array<string>, industry string")
    templates = spark.createDataFrame([("lever", "https://l/{slug}")], "adapter string, template string")
    patterns = spark.createDataFrame([(0, "Takeda", "%武田%")], "pos int, name string, pattern string")
    known = spark.createDataFrame([("Someone",)], "company string")
    assert sorted(tuple(r)[:2] for r in D.expand_candidates(targets, templates, known, patterns).collect()) == [("https://l/t", "Takeda"), ("https://l/u", "Takeda")]
    covered = spark.createDataFrame([("武田制药 Takeda",)], "company string")
    assert [tuple(r)[:2] for r in D.expand_candidates(targets, templates, covered, patterns).collect()] == [("https://l/t", "Other")]


def test_entity_facts_of_odd_json(spark):
    df = spark.createDataFrame([(1, "{}"), (2, "nonsense"), (3, None), (4, '{"id":"Q4","claims":{"P571":[{"mainsnak":{"datavalue":{"value":"text"}}}],"P1128":[{"mainsnak":{"datavalue":{"value":{"amount":"+0"}}}}]}}')], "company_id int, entity string")
    rows = {r["company_id"]: r for r in IN.company_facts(df, spark.createDataFrame([], "qid string, label string")).collect()}
    assert rows[4]["label"] == "Q4" and rows[4]["employees"] == 0 and rows[4]["headcount_band"] is None and rows[4]["listed"] is False and rows[2]["qid"] is None
    assert IN.listing_rows(IN.company_facts(df, spark.createDataFrame([], "qid string, label string"))).where("company_id = 4").first()["listing"] is None
    figures = spark.createDataFrame([("{}",), (None,), ("x",)], "r string").select(FA.reported_figures("r").alias("f")).collect()
    assert [r["f"] for r in figures] == [None, None, None]


def test_board_decisions_by_season(spark):
    results = spark.createDataFrame([("a", 0, 1, 0, None), ("b", 1, 0, 0, None), ("c", 0, 0, 0, "robots_blocked"), ("d", 0, 5, 0, None)], "candidate string, failed int, success int, empty int, reason string")
    boards = spark.createDataFrame([(1, "d", 9), (2, "a", None)], "id int, candidate string, duplicate_of int")
    got = lambda now: {r["candidate"]: (r["state"], str(r["next_retry_at"])[:10]) for r in CA.board_decisions(results, boards, now).collect()}
    assert got("2024-09-01")["a"] == ("empty_board", "2024-09-04") and got("2024-06-01")["a"] == ("empty_board", "2024-06-15")
    assert got("2024-06-01")["b"] == ("no_healthy_jobs", "2024-07-01") and got("2024-06-01")["c"][0] == "robots_blocked" and got("2024-06-01")["d"][0] == "duplicate_board"


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], schemas.TABLES["jobs"]).schema
    store = JobStore(spark, str(tmp_path), schema, buckets=16, files=2)
    empty = {f.name: None for f in schema.fields}

    def batch(urls, title):
        rows = [dict(empty, source_id="s", company="c", title=title, jd_url=u, canonical_jd_url=u) for u in urls]
        return spark.createDataFrame(rows, schema).withColumn("arrived_seq", F.lit(1))

    urls = [f"https://a/{i}" for i in range(60)]
    first = store.upsert(batch(urls, "one"), "2001-01-01", 0)
    assert len(first) > 10 and store.read().count() == 60
    second = store.upsert(batch(urls[:1] + [None, " "], "two"), "2001-01-02", 1)
    assert len(second) == 1 and store.upsert(batch(urls[:1], "three"), "2001-01-03", 1) == []
    rows = {r["jd_url"]: r["title"] for r in store.read().collect()}
    assert len(rows) == 60 and rows[urls[0]] == "two" and rows[urls[1]] == "one"
    versions = store.versions()
    assert sorted(versions.values()).count(1) == 1 and store.events().count() >= 60
    assert store.upsert(batch([], "x"), "2001-01-04", 2) == [] and store.read().count() == 60


def test_keyword_groups_from_json(spark, tmp_path):
    from vacancylake.sources import dims
    (tmp_path / "g.json").write_text(json.dumps([{"function": "A", "terms": ["ai", " java ", "AI engineer"]}, {"function": None, "terms": ["数据"]}, {"function": "B", "terms": ["", None]}]))
    assert dims.keyword_groups(spark, str(tmp_path / "g.json")) == [("A", ["ai", "java", "AI engineer"]), (None, ["数据"])]


def test_campus_page_lists_cycles(spark):
    jobs = spark.sql("select 'a' as id, 'Acme' as company, '2027届校园招聘' as title, '校招' as job_type, 'https://x/campus/1' as jd_url, 'x' as summary, '' as experience, cast(null as int) as grad_class, 'active' as status, timestamp '2024-08-01' as last_seen_at")
    dim = spark.sql("select * from values (0, 'Acme', '%acme%'), (1, 'Other', '%other%') as t(pos, name, pattern)")
    sources = spark.sql("select 1 as id, 'Acme' as company, true as enabled, 'campus' as board")
    cycles = spark.sql("""select * from values (1, 7, '秋招', '正式批', '开放', 9, 10, 'verified', date '2030-01-01'), (2, 7, '秋招', '提前批', '开放', 7, 8, 'verified', null),
      (3, 7, '秋招', '提前批', '开放', 6, 8, 'draft', null), (4, 7, '春招', '补录', '开放', 3, 4, 'verified', date '2020-01-01') as t(id, company_id, season, batch, event, month_start, month_end, verify_status, valid_until)""")
    profiles = spark.createDataFrame([(0, 7, "ACME Inc.", ["x"])], "pos int, profile_id int, name string, aliases array<string>")
    rows = {r["name"]: r for r in CA.campus_page(jobs, dim, sources, "2024-08-02 00:00:00", cycles, profiles).collect()}
    assert [(c["id"], c["batch"]) for c in rows["Acme"]["cycles"]] == [(2, "提前批"), (1, "正式批")] and rows["Other"]["cycles"] is None and rows["Acme"]["window"] == "hiring"
