"""Registered queries over tables written by the test: whole tables are read, whichever side Spark broadcasts."""
from vacancylake.plans import catalog
from vacancylake.plans.registry import Tables

POSTS = 60


def write(spark, folder, documents=40, words=5):
    """Few rows of every table behind the role tables of postings, users and claims."""
    def put(name, sql):
        spark.sql(sql).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    day = "timestamp '2001-05-20 00:00:00'"
    put("region", "select 0 as r_regionkey, 'ASIA' as r_name")
    put("nation", "select cast(id as int) as n_nationkey, concat('NATION', id) as n_name, 0 as n_regionkey from range(2)")
    put("supplier", "select id as s_suppkey, concat('Supplier#', lpad(id, 9, '0')) as s_name, cast(id % 2 as int) as s_nationkey from range(8)")
    put("customer", "select id as c_custkey, concat('Customer', id) as c_name, cast(id % 2 as int) as c_nationkey, 'BUILDING' as c_mktsegment from range(30)")
    put("part", "select id as p_partkey, concat('part ', id) as p_name, 'TYPE' as p_type, 'Brand#1' as p_brand, cast(id as int) as p_size from range(10)")
    put("orders", f"select id as o_orderkey, id % 8 as o_custkey, 'F' as o_orderstatus, {day} as o_orderdate, '1-URGENT' as o_orderpriority from range({POSTS})")
    put("lineitem", f"""select id as l_orderkey, id % 10 as l_partkey, id % 8 as l_suppkey, cast(id % 5 as int) as l_linenumber, cast(id % 9 as double) as l_quantity, 'N' as l_returnflag, {day} as l_shipdate from range({POSTS})""")
    put("documents", f"select id as doc_id, concat('text ', id, ' ', array_join(transform(sequence(1, {words}), i -> sha2(concat(id, '-', i), 256)), ' ')) as text, 'en' as lang, 'web' as source, 9 as n_chars from range({documents})")
    return str(folder)


def test_career_notes_reads_every_user_and_company(spark, tmp_path):
    got = sorted(tuple(r) for r in catalog.QUERIES["career_notes"](spark, write(spark, tmp_path)).select("user_id", "pos", "item_pos", "kind").collect())
    # claim i is of company o_custkey % 50 and of dimension i % 5; users meet the suppliers of their nation
    want = sorted((u, s, i, "caution" if i % 5 == 3 else "path_note") for u in range(30) for s in range(8) for i in range(POSTS) if u % 2 == s % 2 and i % 8 == s and i % 5 in (3, 4))
    assert got == want and any(u % 20 != s % 20 for u, s, _, _ in got)


def test_jobs_join_when_postings_are_the_broadcast_side(spark, tmp_path):
    folder = write(spark, tmp_path, words=200)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # between the size of the postings and that of the texts
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
        some = spark.range(0, POSTS, 7).selectExpr("id as l_orderkey")
        jobs = Tables(spark, folder).jobs.where("summary is not null").join(some, "l_orderkey", "left_semi").select("l_orderkey", "summary")
        rows = jobs.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["l_orderkey"], r["summary"].split(" ")[1]) for r in rows) == [(k, str(k % 40)) for k in range(0, POSTS, 7)]
