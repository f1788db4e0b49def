import random
import re
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from vacancylake.llm import jaccard_join, shingles
from vacancylake.llm.common import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
    sets = [runs(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), i), i) if i is not None and low.get(root(k), i) is not None else i
    return sorted(((i, len(sets[k]), low[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice((3, 5, 12, 60, 90)))] for _ in range(12)]
    passage = [rng.choice(vocab) for _ in range(50)]
    rows = []
    for i in rng.sample(range(10 * n), n):
        kind = rng.random()
        words = list(base[0] if kind < 0.35 else rng.choice(base))
        if kind < 0.8:
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        if kind > 0.9:
            words = passage + words
        rows.append((i, rng.choice((" ", "\n", "  \t")).join(words).upper() if kind < 0.1 else " ".join(words)))
    return rows


@pytest.mark.parametrize("region,task", [(2_000_000, 500_000), (300, 200)])
def test_groups_match_all_pairs(documents, monkeypatch, region, task):
    monkeypatch.setattr(jaccard_join, "REGION", region)
    monkeypatch.setattr(jaccard_join, "TASK", task)
    rows = corpus(1)
    rows += [(9001, None), (9002, ""), (9003, " \n\t"), (None, rows[0][1]), rows[3], rows[3], (9004, "w1"), (9005, "W1"), (9006, "long " * 30000)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(documents(rows)).collect()), key=str)
    assert got == plain(rows)


def test_little(documents):
    assert jaccard_join.jaccard_groups(documents([])).count() == 0
    assert [tuple(r)[:3] for r in jaccard_join.jaccard_groups(documents([(4, "a b c d e f")])).collect()] == [(4, 2, 4)]
    kept = jaccard_join.keep_first(documents([(2, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (3, None), (1, "A b c d e f")]))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["text"]) == [(0, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f")] and kept.count() == 4


def test_shingles_and_prefixes():
    rng = random.Random(7)
    for t in ["", " ", "a", "A b\x0bc", "a b c d e", "é É x y z q"] + [" ".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(50)]:
        assert len(shingles.shingle_set(t)) == len(runs(t)), t
    assert (shingles.shingle_set("A b\nc") == shingles.shingle_set(" a\tb  c")).all()
    assert len(shingles.prefix(shingles.shingle_set("a b c d e f g h i j k l m n"), *[shingles.shingle_set("x")] * 2)) == 3


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (200, 150), (150, 300)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[101] == 100 and got[300] == got[200] == 150
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    text = lambda n=60: " ".join(rng.choices(words, k=n)).capitalize() + "."
    rows = [(i, text() if i % 5 else "###$$$ " * 40) for i in range(200)]
    copy = rows[1][1] + " and"
    rows += [(300, copy), (301, rows[2][1]), (302, text() + "\nA shared line of licence text"), (303, text() + "\nA shared line of licence text"), (304, text() + " password=abcdef1234"), (305, None), (None, text()), (306, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(bool(i % 5))) for i in range(200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "best_fit_packing":
            assert now.columns == docs.columns
            after[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert set(after["quality_classifier"]) - {305, 306} == {i for i, _ in rows} - set(range(0, 200, 5)) - {305, 306}  # on texts of no words the rules decide
    assert after["line_dedup"][302].endswith("licence text") and "licence" not in after["line_dedup"][303] and after["line_dedup"][301] == ""
    assert set(after["line_dedup"]) - set(after["jaccard_join"]) == {300}
    assert after["secret_scan"][304].endswith("[secret]") and after["secret_scan"][1] == rows[1][1]
    assert {r["doc_id"] for r in now.collect()} == set(after["secret_scan"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_linked_pairs_in_stripes_are_those_of_plain_search(monkeypatch):
    rng = np.random.default_rng(3)
    base = [rng.choice(200, 12, replace=False) for _ in range(6)]
    sets = [np.unique(np.where(rng.random(12) < 0.08, rng.integers(0, 300, 12), base[i % 6])).astype(np.int64) for i in range(150)]
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    for cells in (1 << 22, 1000, 100):
        monkeypatch.setattr(shingles, "CELLS", cells)
        got = [(int(x), int(y)) for a, b in shingles.Members(sets).linked(np.arange(150)) for x, y in zip(a, b)]
        assert len(got) == len(set(got)) and set(got) == want


def test_many_alike_but_unlinked_sets_stay_small():
    sets = [np.array([1, 2, 3, 4, 5, 100 + 2 * i, 101 + 2 * i], np.int64) for i in range(6000)]
    sets += [np.arange(10**6, 10**6 + 10), np.arange(10**6, 10**6 + 9)]
    tracemalloc.start()
    links = shingles.region_links(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == [(6000, 6001)] or links == [(6001, 6000)]
    assert peak < 150e6, peak  # 6000 x 6000 floats alone are 144 MB


def test_regions_of_many_rows_are_dealt(documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROWS", 7)
    same = "one two three four five six seven eight nine"
    rows = [(i, f"{same} w{i} x{i}") for i in range(60)] + [(100 + i, f"{same} ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen " + "end" * (i % 2)) for i in range(6)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(documents(rows)).collect()}
    assert got == {i: i for i in range(60)} | {100 + i: 100 for i in range(6)}
