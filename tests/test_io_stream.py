"""Sources, SQL functions and streams: the stream result equals the batch twin."""
import json

from pyspark.sql import functions as F

from vacancylake.functions import register as R, tokens as K, urls as U
from vacancylake.operators import campus as CA
from vacancylake.sources import dims, tables
from vacancylake.streaming import jobs as ST


def test_must_apply_dimension(spark, tmp_path):
    p = tmp_path / "list.json"
    p.write_text(json.dumps({"金融": [{"name": "A", "pattern": "%a%"}], "教育": [{"name": "A", "pattern": "%a%"}, {"name": "B", "pattern": "%b%", "parentPattern": "%p%", "brandTokens": ["b"]}]}))
    rows = {r["pattern"]: r for r in dims.must_apply_dim(spark, {"domestic": str(p)}).collect()}
    assert rows["%a%"]["industries"] == ["教育", "金融"] and rows["%b%"]["parent_pattern"] == "%p%"


def test_raw_landing_keeps_corrupt_rows(spark, tmp_path):
    p = tmp_path / "raw.json"
    p.write_text('{"title":"A","jd_url":"u"}\n{broken\n')
    df = tables.read_raw_jobs(spark, str(p)).cache()
    assert df.where("_corrupt_record is not null").count() == 1 and df.where("title = 'A'").count() == 1


def test_payload_mapping(spark):
    body = json.dumps([{"text": "Eng", "hostedUrl": "https://x/1", "createdAt": 1767225600000, "descriptionPlain": "d", "categories": {"location": "Singapore", "commitment": "Full"}},
                       {"text": "Eng2", "hostedUrl": "https://x/2", "createdAt": 1767225600000, "descriptionPlain": "d", "categories": {"location": "Paris", "commitment": "Full"}}])
    df = spark.createDataFrame([("s", ["SG"], body)], "source_id string, regions array<string>, payload string")
    got = dims.map_payloads(df, "lever").collect()
    assert [(r["title"], r["posted_at"]) for r in got] == [("Eng", "2026-01-01")]


def test_sql_functions_equal_columns(spark):
    R.register(spark)
    df = spark.createDataFrame([("https://a.com/x/?utm_a=1&b=2",), ("https://a.com/?spm=1",), ("https://a.com/#x",), ("数据 go c+",)], "u string")
    df.createOrReplaceTempView("u_view")
    for sql, col in (("canonical_url(u)", U.canonical_url("u")), ("search_tokens(u)", K.search_tokens("u"))):
        assert [r[0] for r in spark.sql(f"select {sql} from u_view").collect()] == [r[0] for r in df.select(col).collect()]


SNAPS = "source_id string, campus_count long, captured_at timestamp"


def test_surge_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select cast(s as string) as source_id, cast((s * 17 + d * d * 5) % 90 as bigint) as campus_count, timestamp '2026-01-01' + make_interval(0,0,0,d) as captured_at from range(4) a(s) cross join range(6) b(d)")
    path = str(tmp_path / "snaps")
    rows.repartition(3).write.parquet(path)
    out = str(tmp_path / "out")
    q = (ST.stream_surges(spark.readStream.schema(SNAPS).parquet(path)).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {(r["source_id"], str(r["captured_at"])): r["surge"] for r in spark.read.parquet(out).collect()}
    want = {(r["source_id"], str(r["captured_at"])): r["surge"] for r in CA.surges(rows).collect()}
    assert got == want


def test_event_dedupe_stream(spark, tmp_path):
    path = str(tmp_path / "ev")
    spark.sql("select concat('k', id % 3) as event_key, timestamp '2026-01-01' as occurred_at from range(9)").write.parquet(path)
    q = (ST.stream_events(spark.readStream.schema("event_key string, occurred_at timestamp").parquet(path)).writeStream.format("memory")
         .queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.table("dedup").count() == 3
