import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacancylake.llm import embedding_dedup, mtree
from vacancylake.llm.hnsw import Graph

KIND = "vec_id long, embedding array<float>"


def data(seed=0, n=400, dim=8, groups=30):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    vec = base[rng.integers(0, groups, n)] + rng.normal(scale=0.15, size=(n, dim))
    vec[::7] = vec[3]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vec)]
    odd = [(1000, None), (1050, [1.0, None] + [0.0] * (dim - 2)), (1100, [math.nan] * dim), (1150, [math.inf] + [0.0] * (dim - 1)), (1200, [0.0] * dim), (1250, []), (None, rows[0][1]), (1300, [1.0, 2.0]), (1350, [2.0, 1.0])]
    return rows, odd


def plain_top(rows, k):
    ok = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, x in ok.items():
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok.items() if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 40])
def test_top_k_matches_a_scan(spark, monkeypatch, shard):
    monkeypatch.setattr(mtree, "SHARD_ROWS", shard)
    monkeypatch.setattr(mtree, "LEAF", 8)
    monkeypatch.setattr(mtree, "BLOCK_ROWS", 4)
    rows, odd = data()
    df = spark.createDataFrame(rows + odd + rows[:3], KIND)
    got = sorted(tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == plain_top(rows + odd, 5)


def test_top_k_of_little(spark):
    assert mtree.top_k(spark.createDataFrame([], KIND), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 9), (1, [0.5, 0.5], 9), (2, [0.5, 0.5], 9)], KIND + ", score int")
    assert sorted(tuple(r) for r in mtree.top_k(few, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 1, 128 * 256), (0, 2, 2, 128 * 256)]


def test_tree_skips_most_distances():
    rng = np.random.default_rng(1)
    ints = (rng.integers(-40, 40, (8, 4)) * 100)[rng.integers(0, 8, 4000)] + rng.integers(-5, 5, (4000, 4))
    square = float((ints.astype(float) ** 2).sum(1).max())
    import pandas as pd
    tree = mtree.Tree(pd.DataFrame(mtree.build_pages(np.arange(4000), ints, square)), 4, square)
    opened = []
    leaf = tree.leaf
    tree.leaf = type("Seen", (), {"__getitem__": lambda self, p: (opened.append(p), leaf[p])[1]})()
    got = tree.search(np.array([0]), ints[:1], 5, np.array([-np.inf]))
    best = sorted((-int(ints[0] @ y), i) for i, y in enumerate(ints) if i)[:5]
    assert got == [(0, i, -s) for s, i in best] and len(set(opened)) < len(leaf) / 4


def plain_groups(rows, limit):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(ok)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(ok)
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= limit:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(ok):
        low[root(k)] = min(low.get(root(k), i), i)
    out = [(i, links[k], low[root(k)], i == low[root(k)]) for k, (i, _) in enumerate(ok)]
    return sorted(out + [(i, 0, i, i is not None) for i, _ in rows if i not in {j for j, _ in ok}], key=str)


def test_near_duplicates_match_a_scan(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 100)
    rows, odd = data(2)
    rows[5] = (5, [2 * x for x in rows[6][1]])  # the same direction
    df = spark.createDataFrame([r + ("x",) for r in rows + odd], KIND + ", rep string")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == plain_groups(rows + odd, 0.95)


def test_near_duplicates_of_little(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in (4, 3, 9)] + [(3, [1.0, 2.0])], KIND)
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(same).collect()) == [(3, 3, 3, True)] * 2 + [(4, 3, 3, False), (9, 3, 3, False)]


def test_beams_widen_and_recall_holds():
    rng = np.random.default_rng(4)
    vec = np.concatenate((rng.normal(size=(1500, 16)), rng.normal(size=(1, 16)) + rng.normal(scale=0.02, size=(700, 16))))
    vec /= np.linalg.norm(vec, axis=1)[:, None]
    graph = Graph.load(vec, Graph(vec).dump())
    q, node = embedding_dedup.near(graph, vec, vec, 0.95)
    truth = (vec @ vec.T >= 0.95).sum()
    assert len(q) == len(set(zip(q.tolist(), node.tolist()))) and len(q) >= 0.97 * truth
