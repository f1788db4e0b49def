"""Recall: shared lists give the draws of a plain pairing, and users are not paired with all their matches."""
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vacancylake.functions import fixed as V, keywords as KW, text as T
from vacancylake.functions.base import at, text
from vacancylake.operators import core as C, feed as FD, search as S

NOW = "2001-06-01 00:00:00"


def plain_recall(profiles, jobs, actions, now, budget):
    """Every user with every match."""
    since = at(now) - F.expr("interval 7 days")
    live = FD.with_search_doc(jobs).where((F.col("status") == "active") & (F.col("last_seen_at") >= since) & (F.length(F.trim("summary")) >= V.MIN_SUMMARY_CHARS))
    clauses = FD.profile_clauses(profiles)
    mine = clauses.select("user_id", "tier", "ckey").join(S.match_clauses(live, clauses), "ckey").select("user_id", "tier", "id").distinct()
    city = mine.where("tier = 'cityNew'").select("user_id", "id", F.lit(True).alias("_city"))
    choosy = clauses.where("tier = 'cityNew'").select("user_id", F.lit(True).alias("_choosy")).distinct()
    p = profiles.select("user_id", "profile_scope", "target_regions", "stage", "exclude_keywords")
    rows = mine.join(live, "id").join(p, "user_id").where(FD.scope_ok() & S.stage_prefilter(F.col("stage")) & ((F.col("tier") != "cityNew") | (F.col("first_seen_at") >= since)))
    rows = rows.where(~S.excluded("exclude_keywords")).join(actions.where("action <> 'viewed'").select("user_id", F.col("job_id").alias("id")).distinct(), ["user_id", "id"], "left_anti")
    rows = rows.join(city, ["user_id", "id"], "left").join(choosy, "user_id", "left")
    near = F.when(F.col("_choosy").isNull() | (F.col("tier") == "cityNew"), 0).when(F.col("_city"), 0).when(F.trim(text("location")) == "", 1).otherwise(2)
    tier = F.when(F.col("tier") == "role", 0).when(F.col("tier") == "company", 1).otherwise(2)
    rows = rows.select("user_id", "id", "tier", "first_seen_at", near.alias("_near"), tier.alias("_tier"))
    drawn = C.weighted_round_robin(rows, ["user_id"], "_tier", [F.col("_near"), F.col("first_seen_at").desc(), F.col("id")], FD.weight_of("_tier"), budget)
    return C.latest_per_key(drawn, ["user_id", "id"], [F.col("tier_rn") / FD.weight_of("_tier"), F.col("_tier")]).select("user_id", "id", "tier")


def jobs_of(spark, n=240):
    day = datetime(2001, 5, 31)
    places = ["北京", "Remote", "", None, "上海", "New York"]
    out = []
    for i in range(n):
        seen = None if i % 41 == 0 else day - timedelta(hours=(i * 7) % 400)
        out.append((f"j{i:03d}", ["alpha builder", "beta keeper", "alpha beta intern", "other"][i % 4], f"firm {i % 3}", places[i % 6], [None, "校招", "实习"][i % 3], f"http://x/{i}",
                    ("widget " if (i * 7) % 400 < 250 else "plain ") + "word " * 60, None, ["domestic", "overseas", None][i % 3], [None, "US", "sg"][i % 5 % 3], seen, day, "active" if i % 17 else "expired"))
    out += out[8:12]  # ids occur twice
    return spark.createDataFrame(out, "id string, title string, company string, location string, job_type string, jd_url string, summary string, salary_text string, job_scope string, "
                                      "country_code string, first_seen_at timestamp, last_seen_at timestamp, status string")


def profiles_of(spark, rows):
    schema = ("user_id long, profile_scope string, target_regions array<string>, target_roles array<string>, target_keywords array<string>, target_companies array<string>, "
              "target_locations array<string>, target_industries array<string>, exclude_keywords array<string>, stage string, ready boolean")
    return FD.with_query_sets(spark.createDataFrame([(*r, True) for r in rows], schema))


def user(i, scope="all", regions=(), roles=("alpha",), words=(), firms=(), cities=(), exclude=(), stage=""):
    return (i, scope, list(regions), list(roles), list(words), list(firms), list(cities), [], list(exclude) if exclude is not None else None, stage)


def test_recall_equals_plain_pairing(spark):
    jobs = jobs_of(spark)
    users = [user(1), user(2), user(3, cities=["北京"]), user(4, "domestic", words=["beta"], firms=["firm 1"]), user(5, "overseas", ["US", "Remote", "SG"], cities=["Remote", "上海"]),
             user(6, exclude=[" Widget"]), user(7, exclude=["widget", ""], cities=["北京"], stage="实习"), user(8, stage="校招", exclude=None), user(9, stage=None), user(None),
             user(10, firms=["firm 2"]), user(10, firms=["firm 2"]), user(11, roles=["nothing"]), user(12, exclude=["word"]), user(13, roles=["beta", "alpha"], words=["alpha"])]
    profiles = profiles_of(spark, users)
    # users 2 and 3 acted on the newest postings: their lists must be read deeper
    newest = [r.id for r in jobs.where("title like 'alpha%'").orderBy(F.col("first_seen_at").desc()).limit(70).collect()]
    acted = [(u, j, "saved") for u in (2, 3) for j in newest] + [(1, newest[0], "viewed"), (4, "j004", "ignored"), (None, "j004", "saved")]
    actions = spark.createDataFrame(acted, "user_id long, job_id string, action string")
    want = [tuple(r) for r in plain_recall(profiles, jobs, actions, NOW, 4).collect()]
    got = [tuple(r) for r in FD.recall(profiles, jobs, actions, NOW, 4).collect()]
    assert sorted(got) == sorted(want)
    assert len([r for r in got if r[0] in (2, 6)]) == 8 and not [r for r in got if r[0] in (12, None)]


def test_recall_does_not_pair_users_with_matches(spark, monkeypatch):
    ranked, real = [], C.weighted_round_robin

    def watched(df, *args):
        ranked.append(df.count())
        return real(df, *args)

    monkeypatch.setattr(C, "weighted_round_robin", watched)
    profiles = profiles_of(spark, [user(i, cities=["北京"] if i % 2 else []) for i in range(300)])
    got = FD.recall(profiles, jobs_of(spark), spark.createDataFrame([(5, "j000", "saved")], "user_id long, job_id string, action string"), NOW, 5)
    assert got.select("user_id").distinct().count() == 300
    assert sum(ranked) < 300  # 300 users meet some 100 postings each


def test_crowded_class_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(FD, "USERS_PER_LIST", 10)
    users = spark.range(95).select(F.col("id").alias("user_id"), F.lit("c").alias("class"))
    out = FD._handed(users, spark.createDataFrame([("c", "a", "role"), ("c", "b", "role"), ("d", "e", "role")], "class string, id string, tier string"))
    assert out.count() == 190 and out.select("user_id", "id").distinct().count() == 190


def test_words_are_read_once_in_order(spark):
    schema = "user_id long, target_roles array<string>, target_keywords array<string>, target_companies array<string>, target_industries array<string>"
    rows = [(1, ["算法", "Product Manager"], ["python"], ["A"], ["互联网"]), (1, ["算法", "Product Manager"], ["python"], ["A"], ["互联网"]), (2, [], [], [], []),
            (3, ["x", "x", None], ["x"], None, None), (4, None, ["前端"], [], []), (None, ["前端", "算法"], None, [], [])]
    p = spark.createDataFrame(rows, schema)
    for overseas in (False, True):
        gs = KW.vocabulary(None, overseas)
        read = lambda c: F.transform(c, lambda r: KW.query_features(r, gs, overseas))
        want = p.select("user_id", "target_roles", read(F.concat("target_roles", "target_keywords")).alias("role_q"), read(F.col("target_keywords")).alias("keyword_q"),
                        F.array_distinct(F.filter(F.transform("target_roles", lambda r: T.job_function(r, None)), lambda f: f != "其他")).alias("user_fns"))
        got = FD.with_query_sets(p, None, overseas).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
