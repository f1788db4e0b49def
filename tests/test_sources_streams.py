"""Versioned tables, remaining sources and streams, and column functions that no query reads."""
import json

import pytest
from pyspark.sql import functions as F

from vacancylake import schemas
from vacancylake.functions import company as CO, dates as D, text as T, urls as U
from vacancylake.operators import insights
from vacancylake.sources import dims, tables
from vacancylake.streaming import jobs as ST


def run(stream, path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/cp-{name}").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_a_table_keeps_its_versions(spark, tmp_path):
    name = "sources"
    one = spark.createDataFrame([], schemas.TABLES[name])
    first = tables.write_table(one, str(tmp_path), name, "v1")
    second = tables.write_table(spark.read.schema(schemas.TABLES[name]).parquet(first), str(tmp_path), name, "v2")
    assert first != second and spark.read.schema(schemas.TABLES[name]).parquet(first).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_table(one, str(tmp_path), name, "v1")
    assert "board" in tables.read_table(spark, str(tmp_path), name).columns


def test_upsert_stream_stamps_each_batch(spark, tmp_path):
    source = spark.createDataFrame([("s1", "Acme", "https://acme.com/jobs")], "id string, company string, source_url string")
    store, seen = {}, []

    def read_store(session):
        return store.get("jobs", session.createDataFrame([], schemas.TABLES["jobs"]))

    def publish(jobs, events, batch_id):
        path = f"{tmp_path}/store-{batch_id}"
        jobs.write.mode("overwrite").parquet(path)
        store["jobs"] = jobs.sparkSession.read.parquet(path)
        seen.append(events.count())

    for k, title in enumerate(("Engineer", "Senior Engineer")):
        with open(f"{tmp_path}/in-{k}.json", "w") as f:
            f.write(json.dumps({"source_id": "s1", "title": title, "jd_url": "https://acme.com/jobs/1", "summary": "x" * 80, "arrived_seq": k}))
        batches = spark.readStream.schema(schemas.RAW_JOBS).json(f"{tmp_path}/in-*.json")
        q = ST.stream_upsert(batches, source, read_store, publish, f"{tmp_path}/cp", lambda b: f"2001-01-0{b + 1} 00:00:00").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    row = store["jobs"].collect()
    assert [(r["title"], str(r["first_seen_at"])[:10], str(r["last_seen_at"])[:10]) for r in row] == [("Senior Engineer", "2001-01-01", "2001-01-02")] and seen == [1, 0]


def test_event_count_and_session_streams(spark, tmp_path):
    rows = spark.sql("select 'u' || id % 2 as user_id, 'job_open' as event, '{\"result\":\"alive\"}' as payload, timestamp '2001-01-01' + make_interval(0,0,0,0,0,cast(id * 7 as int)) as created_at from range(10)")
    path = f"{tmp_path}/ev"
    rows.write.parquet(path)
    read = lambda: spark.readStream.schema(rows.schema).parquet(path)
    run(ST.stream_event_counts(read()), tmp_path, "counts")
    assert [(r["event"], r["n"]) for r in spark.table("counts").collect()] == [("job_open", 10)]
    run(ST.stream_sessions(read(), gap="15 minutes"), tmp_path, "sessions")
    batch = rows.groupBy(F.session_window("created_at", "15 minutes"), "user_id").agg(F.count("*").alias("runs"))
    assert sorted(r["runs"] for r in spark.table("sessions").collect()) == sorted(r["runs"] for r in batch.collect())


def test_dimension_readers(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps([["Acme", "tech"], ["Bank", "finance"]]))
    assert [(r["pos"], r["name"], r["industry"]) for r in dims.industry_overrides(spark, str(tmp_path / "o.json")).orderBy("pos").collect()] == [(0, "Acme", "tech"), (1, "Bank", "finance")]
    (tmp_path / "l.json").write_text(json.dumps({"a": [{"name": f"n{i}", "pattern": f"%{i}%"} for i in range(1200)], "b": [{"name": "z", "pattern": "%z%"}]}))
    got = dims.must_apply_dim(spark, {"d": str(tmp_path / "l.json")})
    assert got.select("pos").distinct().count() == 1201 and got.orderBy(F.desc("pos")).first()["name"] == "z"
    assert dims.union_patterns(got).count() == 1201


def test_columns(spark, one):
    long_tier = "$100K – $200K " + "and equity " * 30
    assert one(lambda: T.salary_from_comp("s"), s=json.dumps({"compensationTierSummary": long_tier})) == long_tier.strip()
    assert [one(lambda: U.host_under("a", "b"), a=a, b=b) for a, b in (("x.com", "x.com"), ("a.x.com", "x.com"), ("x.com", "a.x.com"), ("ax.com", "x.com"))] == [True, True, True, False]
    assert one(lambda: CO.nfkc("s"), s="ﬁ①ｱ") == "fi1ア"
    assert one(lambda: D.official_times("a", "b", "c", "d")["posted_at"], a="", b="2026-01-02", c="", d="") == "2026-01-02"


def test_change_on_the_year_before(spark):
    f = spark.createDataFrame([("a", "revenue", 1, 100.0), ("a", "revenue", 2, 125.5), ("b", "revenue", 1, 0.0), ("b", "revenue", 2, 5.0), ("c", "revenue", 1, -4.0), ("c", "revenue", 2, -2.0)], "company string, metric string, fiscal_end int, value double")
    assert {r["company"]: r["yoy_pct"] for r in insights.annual_financials(f).collect()} == {"a": 25.5, "b": None, "c": 50.0}
