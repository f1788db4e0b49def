import random

import numpy as np
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from vacancylake.llm import cuckoo, line_dedup
from vacancylake.llm.line_dedup import LineIndex, dedup_lines, document_lines

BLANK = " \t\n\x0b\x0c\r"


def plain(rows):
    """Kept text and dropped lines for each row, by plain loops."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first, more = {}, set()
    key = lambda x: x.strip(BLANK).translate(low)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                k = key(x)
                if len(k) >= 10:
                    if k in first and first[k] != i:
                        more.add(k)
                    first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in more or first[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r["doc_id"], r["r"]["text"], r["r"]["n_lines"], r["r"]["n_dropped"]) for r in dedup_lines(df, out="r").collect()), key=str)


def test_matches_plain_loops(documents):
    rng = random.Random(3)
    lines = ["short", "", "A line that REPEATS", "  a line that repeats\t", "ünïcode is ten", "ÜNÏCODE IS TEN", "another long line", "x" * 5000]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)))) for i in rng.sample(range(100), 40)]
    rows += [(7, "A line that repeats"), (7, "A line that repeats"), (None, "another long line\nb"), (None, None), (200, None), (201, "")]
    assert run(documents(rows)) == plain(rows)


def test_empty_table_and_other_columns(spark, documents):
    assert run(documents([])) == []
    df = spark.createDataFrame([(1, "same long line", 5, "k"), (2, "same long line", 6, "l")], "doc_id long, text string, shard int, key string")
    got = dedup_lines(df).orderBy("doc_id").collect()
    assert [(r["shard"], r["key"], r["line_dedup"]["text"]) for r in got] == [(5, "k", "same long line"), (6, "l", "")]


def counts(index):
    return sorted((bytes(r["key"]), r["n"], r["first_doc"]) for r in index.counts.collect())


def test_insert_is_idempotent_and_delete_reverses(spark, documents):
    a = document_lines(documents([(i, f"shared line one\nown line of {i}") for i in range(1, 30)]))
    b = document_lines(documents([(0, "shared line one\nnew line here"), (50, "new line here\nonly in fifty")]))
    one = LineIndex(spark).insert(a)
    two = one.insert(b)
    assert counts(two.insert(b)) == counts(two)
    assert {(n, d) for _, n, d in counts(two) if n > 1} == {(30, 0), (2, 0)}
    back = two.delete(spark.createDataFrame([(0,), (50,), (50,), (99,), (None,)], "doc_id long"))
    assert counts(back) == counts(one)
    assert [bytes(r["slots"]).count(0) for r in back.filters.collect()] == [bytes(r["slots"]).count(0) for r in one.filters.collect()]
    assert LineIndex(spark).delete(spark.createDataFrame([(1,)], "doc_id long")).refs is None


def test_index_outgrows_its_filters(spark, documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    index = LineIndex(spark).insert(document_lines(documents([(1, "the first long line")])))
    index = index.insert(document_lines(documents([(i, f"line number {i:06d}") for i in range(200)])))
    assert index.shards > 1 and index.counts.count() == 201
    probe = index._probe(index.counts.selectExpr("key", "n as n2", "first_doc as first2"))
    assert probe.where("not maybe").count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32 - 1))
def test_cuckoo_keeps_what_it_is_told(n, seed):
    keys = list({np.random.default_rng(seed + i).bytes(16) for i in range(n)})
    tab = cuckoo.empty(cuckoo.buckets_for(len(keys)))
    assume(cuckoo.insert(tab, keys))  # a table of a bucket or two may be too full
    assert cuckoo.contains(tab, keys).all()
    cuckoo.remove(tab, keys[::2])
    assert cuckoo.contains(tab, keys[1::2]).all() and (tab != 0).sum() == len(keys[1::2])
    cuckoo.remove(tab, keys[1::2])
    assert not tab.any()
