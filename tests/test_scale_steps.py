"""Steps that must not grow with the product of their sides: equal answers, and no pairs of rows that share a key."""
from pyspark.sql import functions as F

from vacancylake.operators import campus as CA, core as C, coverage as CV, insights as IN, search as S

NOW = "2001-08-02 00:00:00"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lists_of(spark):
    return spark.createDataFrame([("a", 1, "c1", "B1", 3), ("a", 2, "c2", "B2", 9), ("a", 3, "c3", "B3", None), ("b", 4, "c1", "B4", 1)], "list string, pos int, company string, display_name string, job_count int")


def items_of(spark):
    return spark.createDataFrame([("c1", "timing", 1, "7-9 月", None, None), ("c2", "culture", 2, None, "note", "x"), ("c1", "path", 3, None, "p", "y"), ("c1", "culture", 4, None, "q", "z")],
                                 "company string, dimension string, pos long, time_window string, title string, content string")


def test_career_path_of_lists_equals_ranking_every_user(spark):
    users = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (4, "b"), (None, "a"), (None, "b"), (5, None), (6, "zz")], "user_id long, list string")
    lists, items = lists_of(spark), items_of(spark)
    out = ["user_id", "pos", "company", "status", "job_count", "caution_note", "rank"]
    each = IN.career_path(users.join(lists, "list").drop("list"), items, NOW).select(*out)
    shared = IN.career_path(users, items, NOW, lists).select(*out)
    assert rows(each) == rows(shared) and shared.count() == 15


def test_career_notes_deal_the_rows_of_a_company(spark):
    wanted = spark.range(200).select(F.col("id").alias("user_id"), F.lit(1).alias("pos"), F.lit("c1").alias("company"), F.lit(None).cast("string").alias("display_name"))
    notes = IN.career_notes(wanted, items_of(spark))
    assert notes.count() == 400 and notes.distinct().count() == 400
    assert "_slot" in notes._jdf.queryExecution().optimizedPlan().toString()  # one company is not one task


def test_token_search_measures_without_pairs(spark):
    docs = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a"]), ("3", ["a", "b", "c"])], "id string, search_doc array<string>")
    cl = spark.createDataFrame([(q, 0, ["a", "b"]) for q in range(5)] + [(9, 0, ["a"]), (9, 1, ["c"]), (8, 0, ["none"])], "query_id int, grp int, tokens array<string>")
    pairs = S.token_search(docs, cl).groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    told = S.token_search(docs, cl, measures=[F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")])
    assert rows(pairs) == rows(told) == [(0, 2, "1", "3"), (1, 2, "1", "3"), (2, 2, "1", "3"), (3, 2, "1", "3"), (4, 2, "1", "3"), (9, 1, "3", "3")]


def test_checkpointed_is_a_compressed_table(spark):
    from urllib.parse import urlparse
    import os
    from vacancylake.sources.tables import checkpointed
    out = checkpointed(spark.range(200_000).selectExpr("concat('posting-', id % 7) as id"))
    files = out.inputFiles()
    assert out.count() == 200_000 and files and sum(os.path.getsize(urlparse(f).path) for f in files) < 400_000


def test_patterns_meet_distinct_texts(spark, monkeypatch):
    met, real = [], C.contains_join

    def watched(texts, text_col, needles, needle_col, condition=None):
        met.append((texts.count(), needles.count()))
        return real(texts, text_col, needles, needle_col, condition)

    monkeypatch.setattr(C, "contains_join", watched)
    pats = spark.createDataFrame([(i, "%ac%") for i in range(30)] + [(90, "%"), (91, None), (92, "_b")], "pos int, pattern string")
    names = spark.createDataFrame([(i, "Acme") for i in range(20)] + [(50, "Ab"), (51, None), (52, "")], "sid int, company string")
    got = C.match_patterns(pats, "pattern", names, "company").select("pos", "sid")
    want = names.join(pats, F.expr("company ilike pattern")).select("pos", "sid")
    assert rows(got) == rows(want) and met == [(4, 4)]
    met.clear()
    dim = spark.createDataFrame([(i, f"o{i}", "ac") for i in range(5, 35)] + [(3, "o3", "AC"), (1, "o1", "zz"), (0, "o0", None)], "pos int, owner string, needle string")
    owner = C.assign_first(names.select("company").distinct(), "company", dim, "needle", "pos").select("company", "pos", "owner")
    assert rows(owner) == [("Acme", 3, "o3")] and met == [(4, 3)]


def test_recent_surges_by_needle(spark, monkeypatch):
    met, real = [], C.contains_join
    monkeypatch.setattr(C, "contains_join", lambda a, b, c, d, *e: met.append(c.count()) or real(a, b, c, d, *e))
    dim = spark.createDataFrame([(i, "AC") for i in range(9)] + [(9, "b"), (9, "ac"), (10, None)], "pos int, needle string")
    snaps = spark.createDataFrame([("Acme", 1, "2001-08-01", 5, True), ("Acme", 2, "2001-08-01", 7, True), ("Bolt", 3, "2001-08-02", 9, True), ("Bolt", 3, "2001-08-02", 99, False)],
                                  "company string, source_id int, captured_at string, campus_count int, surge boolean").withColumn("captured_at", F.to_timestamp("captured_at"))
    got = CA.recent_surges(dim, snaps, NOW).select("pos", "campus_count")
    assert rows(got) == sorted([(i, 7) for i in range(9)] + [(9, 9)]) and met == [3]


def coverage_tables(spark):
    runs = spark.createDataFrame([(1, 1, 10, 4), (2, 2, 20, 5), (3, 1, None, 8), (4, 3, 7, 7)], "id int, source_id int, reported_total int, jobs_found int")
    runs = runs.withColumn("started_at", F.expr("timestamp '2001-01-01' + make_interval(0, 0, 0, id)")).withColumn("finished_at", F.lit(None).cast("timestamp"))
    src = spark.createDataFrame([(1, "Acme", True, "campus"), (2, "Acme", True, "social"), (2, "Acme", True, "social"), (3, "Bolt", False, "mixed"), (4, None, True, "campus")], "id int, company string, enabled boolean, board string")
    pats = spark.createDataFrame([(1, "n1", "%ac%"), (2, "n2", "%ac%"), (None, "n0", "%ac%"), (3, "n3", "%bo%"), (4, "n4", "%zz%"), (5, "n5", None)], "pos int, name string, pattern string")
    return runs, src, pats


def test_list_coverage_and_flags_per_distinct_pattern(spark, monkeypatch):
    met, real = [], C.match_patterns
    monkeypatch.setattr(C, "match_patterns", lambda p, a, t, b: met.append(p.columns) or real(p, a, t, b))
    runs, src, pats = coverage_tables(spark)
    cov = CV.list_fetch_coverage(pats.select("pos", "pattern"), src, runs).select("pos", "reported_total", "fetched", "coverage_pct")
    assert rows(cov) == sorted([(1, 20, 13, 65), (2, 20, 13, 65), (None, None, 0, None), (3, None, 0, None), (4, None, 0, None), (5, None, 0, None)], key=repr)
    flags = CV.source_flags(pats, src).select("pos", "has_any", "has_enabled", "has_campus")
    assert rows(flags) == [(1, True, True, True), (2, True, True, True), (3, True, False, False), (4, False, False, False), (5, False, False, False), (None, False, False, False)]
    assert met == [["pattern"], ["pattern"]]


def test_brand_rollup_equals_row_by_row(spark, monkeypatch):
    jobs = spark.createDataFrame([(f"C{i % 7}", "Ring widget" if i % 3 else "Bolt", "active" if i % 5 else "expired", "s" * (100 if i % 2 else 3)) for i in range(140)] + [(None, "Ring", "active", "s" * 90)],
                                 "company string, title string, status string, summary string")
    jobs = jobs.withColumn("first_seen_at", F.to_timestamp(F.lit("2001-08-01"))).withColumn("enrich_checked_at", F.lit(None).cast("timestamp"))
    dim = spark.createDataFrame([(1, "%1%", "%c%", ["ring"]), (2, "%2%", "%c%", ["bolt", "RING"]), (2, "%2%", "%c%", ["bolt", "RING"]), (3, "%c%", "%1%", ["ring"]), (4, "%1%", "%c%", ["ring"]), (4, "%2%", "%c%", ["ring"]),
                                 (5, "%9%", "%3%", ["ring"]), (5, "%9%", "%4%", ["bolt"]), (6, None, "%c%", ["ring"]), (7, "%1%", None, ["ring"]), (8, "%1%", "%c%", [])], "pos int, pattern string, parent_pattern string, brand_tokens array<string>")
    rules = dim.where("parent_pattern is not null and size(brand_tokens) > 0").distinct()
    flags = CV.posting_flags(jobs, NOW)
    held = flags.join(rules, F.expr("company ilike parent_pattern and not (company ilike pattern) and exists(brand_tokens, b -> contains(lower(title), lower(b)))"))
    names = held.select("company", "pos", "brand_tokens").distinct()
    want = flags.join(names, "company").where(F.expr("exists(brand_tokens, b -> contains(lower(title), lower(b)))")).groupBy("pos").agg(*[F.sum(m).alias(m) for m in CV.MEASURES])
    met, real = [], C.match_patterns
    monkeypatch.setattr(C, "match_patterns", lambda p, a, t, b: met.append(p.count()) or real(p, a, t, b))
    got = CV.brand_rollup(jobs, dim, NOW)
    assert rows(got.select("pos", *CV.MEASURES)) == rows(want) and len(rows(want)) == 4
    assert max(met) <= 5  # distinct patterns, not list rows
