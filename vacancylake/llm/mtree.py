"""Exact top-k by inner product over integer vectors: an M-tree in pages, searched best first.

Inner products become distances: a point x gets one more coordinate so that all points lie on a sphere of radius R; then
d(q, x)^2 = |q|^2 + R^2 - 2 q.x, and the nearest points are those of the highest scores.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from vacancylake.llm.common import stored

SCALE, K = 256, 5
LEAF, FAN = 64, 8  # entries of a leaf page, children of an inner page
SHARD_ROWS, PIVOTS, SAMPLE = 4096, 256, 2048  # rows of a shard, regions at most, rows that pivots are chosen from
BLOCK_ROWS = 16_384  # queries that one task asks of a shard
ROUNDING = 1e-9  # share of |q|^2 + R^2 that bounds leave for rounding


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def lifted(ints: np.ndarray, square: float) -> np.ndarray:
    """Points on the sphere of squared radius `square`."""
    x = ints.astype(np.float64)
    return np.concatenate((x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))[:, None]), 1)


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    d = points - center
    return np.sqrt((d * d).sum(1))


def far_apart(points: np.ndarray, most: int) -> np.ndarray:
    """Rows of points, each the farthest from those before; fewer if the points run out."""
    chosen, least = [0], _distances(points, points[0])
    while len(chosen) < most and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, _distances(points, points[chosen[-1]]))
    return np.array(chosen)


def build_pages(ids: np.ndarray, ints: np.ndarray, square: float) -> list[dict]:
    """Pages of a tree over these rows, the root first. Each has a center, a covering radius, its distance from the parent's
    center, and either children or entries with their distances from the center."""
    points, pages = lifted(ints, square), []

    def grow(rows: np.ndarray, parent: int, above: np.ndarray | None) -> None:
        own = points[rows]
        center = own[_distances(own, own.mean(0)).argmin()]
        dist = _distances(own, center)
        page = {"page": len(pages), "parent": parent, "center": center.tobytes(), "radius": float(dist.max()), "parent_dist": 0.0 if above is None else float(_distances(center[None, :], above)[0]),
                "ids": None, "ints": None, "dists": None}
        pages.append(page)
        if len(rows) <= LEAF:
            page |= {"ids": ids[rows], "ints": ints[rows].tobytes(), "dists": dist}
            return
        seeds = far_apart(own, FAN)
        if len(seeds) < 2:  # all the same point: any parts will do
            parts = [rows[a::FAN] for a in range(FAN)]
        else:
            near = np.stack([_distances(own, own[s]) for s in seeds]).argmin(0)
            parts = [rows[near == k] for k in range(len(seeds))]
        for part in parts:
            grow(part, page["page"], center)

    grow(np.arange(len(ids)), -1, None)
    return pages


class Tree:
    def __init__(self, pages: pd.DataFrame, dim: int, square: float):
        pages = pages.sort_values("page")
        self.square = square
        self.center = np.stack([np.frombuffer(c) for c in pages["center"]])
        self.radius, self.parent_dist = pages["radius"].to_numpy(), pages["parent_dist"].to_numpy()
        parent = pages["parent"].to_numpy()
        order = np.argsort(parent, kind="stable")
        cuts = np.searchsorted(parent[order], np.arange(len(pages) + 1))
        self.children = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        self.leaf = [None if i is None else (np.asarray(i, np.int64), np.frombuffer(x, np.int64).reshape(-1, dim), np.asarray(d)) for i, x, d in zip(pages["ids"], pages["ints"], pages["dists"])]

    def search(self, own_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[int, int, int]]:
        """(query's place, id, score) of the k best rows of each query, but itself, that score at least its floor.

        Queries travel together. The page with the highest possible score for any of them is opened next, by those that
        it can still help. A child or an entry is measured only if the triangle inequality on its stored distance leaves
        it a chance.
        """
        q = np.concatenate((queries.astype(np.float64), np.zeros((len(queries), 1))), 1)
        base = (q * q).sum(1) + self.square
        slack = ROUNDING * base + 1e-6
        exact = self.square < 2**52 and base.max() < 2**52  # whole numbers that doubles hold
        scores, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        low = floors.astype(np.float64).copy()

        def most(rows: np.ndarray, dist: np.ndarray) -> np.ndarray:
            """Highest score at this distance or more."""
            shape = (-1,) + (1,) * (dist.ndim - 1)
            return (base[rows].reshape(shape) - np.maximum(dist, 0) ** 2) / 2 + slack[rows].reshape(shape)

        def push(page: int, rows: np.ndarray, dist: np.ndarray) -> None:
            top = most(rows, dist - self.radius[page])
            go = top >= low[rows]
            if go.any():
                heapq.heappush(heap, (-float(top.max()), page, rows[go], dist[go], top[go]))

        heap: list = []
        push(0, np.arange(len(q)), _distances(q, self.center[0]))
        while heap:
            _, page, rows, d, top = heapq.heappop(heap)
            go = top >= low[rows]
            rows, d = rows[go], d[go]
            if not len(rows):
                continue
            if self.leaf[page] is None:
                for kid in self.children[page]:
                    near = most(rows, np.abs(d - self.parent_dist[kid]) - self.radius[kid]) >= low[rows]
                    if near.any():
                        push(kid, rows[near], _distances(q[rows[near]], self.center[kid]))
                continue
            own, ints, dists = self.leaf[page]
            chance = (most(rows, np.abs(d[:, None] - dists[None, :])) >= low[rows][:, None]) & (own[None, :] != own_ids[rows][:, None])
            some, cols = chance.any(1), chance.any(0)
            rows, chance, own = rows[some], chance[some][:, cols], own[cols]
            if not len(rows):
                continue
            points = ints[cols]
            found = queries[rows].astype(np.float64) @ points.T.astype(np.float64) if exact else (queries[rows] @ points.T).astype(np.float64)
            found = np.where(chance & (found >= low[rows][:, None]), found, -np.inf)
            hit = (found > -np.inf).any(1)
            rows = rows[hit]
            both = np.concatenate((scores[rows], found[hit]), 1)
            names = np.concatenate((ids[rows], np.broadcast_to(own, (len(rows), len(own)))), 1)
            order = np.argsort(names, 1, kind="stable")
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(both, order, 1), 1, kind="stable"), 1)[:, :k]
            scores[rows], ids[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
            low[rows] = np.maximum(low[rows], scores[rows, -1])
        at, j = np.nonzero(scores > -np.inf)
        if exact:
            return [(int(a), int(ids[a, b]), int(scores[a, b])) for a, b in zip(at, j)]
        place = {int(i): x for leaf in self.leaf if leaf is not None for i, x in zip(leaf[0], leaf[1])}
        return [(int(a), int(ids[a, b]), int(queries[a] @ place[int(ids[a, b])])) for a, b in zip(at, j)]


@F.pandas_udf(ArrayType(LongType()))
def _scaled(vectors: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else np.floor(SCALE * np.asarray(v, np.float64)).astype(np.int64) for v in vectors], dtype=object)


def top_k(rows: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row where is_query holds, all if there are fewer.

    Scores are inner products of floor(256 * x); ties go to the smaller id; a query is never its own candidate. Null or
    empty vectors, vectors with a null or non-finite component and rows with a null id take no part. Vectors of
    different length are not compared. Rows that repeat an id and its vector count once. Other columns are not read;
    an empty table gives an empty result.

    Rows lie in regions around pivots (chosen from a bounded sample); a region of many rows is dealt to salted shards,
    each with a tree of its own. A query first asks its own region's shard, then only those shards whose region can beat
    what it has.
    """
    some = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    data = stored(some.select("vec_id", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("v").alias("dim"), _scaled("v").alias("ints")), "scaled")
    squares = F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, asking, square = data.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(squares), F.lit(0.0))).first()
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "ints").collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in sample}:
        points = lifted(np.array([r["ints"] for r in sample if r["dim"] == dim], np.int64), square)
        pivots[dim] = points[far_apart(points, min(PIVOTS, max(1, -(-n // SHARD_ROWS))))]

    @F.pandas_udf(StructType().add("region", "long").add("away", "double"))
    def place(vectors: pd.Series) -> pd.DataFrame:
        region, away = [], []
        for x in vectors:
            x = np.asarray(x, np.int64)
            near = _distances(pivots[len(x)], lifted(x[None, :], square)[0]) if len(x) in pivots else np.zeros(1)
            region.append(int(near.argmin()))
            away.append(float(near.min()) if len(x) in pivots else np.inf)
        return pd.DataFrame({"region": region, "away": away})

    placed = stored(data.select("*", place("ints").alias("p")).select("vec_id", "asks", "dim", "ints", "p.region", "p.away"), "placed")
    regions = placed.groupBy("dim", "region").agg(F.count("*").alias("rows"), F.max("away").alias("radius"))
    regions = stored(regions.select("dim", "region", "radius", F.ceil(F.col("rows") / SHARD_ROWS).alias("salts")), "regions")
    placed = placed.join(regions.select("dim", "region", "salts"), ["dim", "region"]).withColumn("salt", F.pmod(F.xxhash64(F.lit("s"), "vec_id"), F.col("salts")))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        ints = np.stack([np.asarray(x, np.int64) for x in part["ints"]])
        ids = part["vec_id"].to_numpy()
        keep = np.unique(np.column_stack((ids, ints)), axis=0, return_index=True)[1]
        pages = pd.DataFrame(build_pages(ids[keep], ints[keep], square))
        return pages.assign(**{c: part[c].iloc[0] for c in ("dim", "region", "salt")})

    page = "page long, parent long, center binary, radius double, parent_dist double, ids array<long>, ints binary, dists array<double>, dim int, region long, salt long"
    pages = stored(placed.groupBy("dim", "region", "salt").applyInPandas(build, page), "pages")
    blocks = max(1, -(-asking // BLOCK_ROWS))
    queries = placed.where("asks").select("vec_id", "ints", "dim", "region", "salt", F.pmod(F.xxhash64(F.lit("b"), "vec_id"), F.lit(blocks)).alias("block"))

    def ask(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            dim = int(own["dim"].iloc[0])
            tree = Tree(own, dim, square)
            ids = asked["vec_id"].to_numpy()
            found = tree.search(ids, np.stack([np.asarray(x, np.int64) for x in asked["ints"]]), k, asked["floor"].to_numpy())
            out = [(ids[a], j, score) for a, j, score in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    def answers(asked: DataFrame) -> DataFrame:
        key = ["dim", "region", "salt", "block"]
        served = pages.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return served.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(ask, "query_id long, vec_id long, score long")

    first = stored(answers(queries.withColumn("floor", F.lit(float("-inf")))), "first")
    have = first.distinct().groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("floor"))
    rest = queries.join(have.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select(*queries.columns, F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    bounds = regions.groupBy("dim").agg(F.collect_list(F.struct("region", "radius", "salts")).alias("all"))

    @F.pandas_udf(ArrayType(StructType().add("region", "long").add("salts", "long")))
    def reachable(vectors: pd.Series, floors: pd.Series, every: pd.Series) -> pd.Series:
        out = []
        for x, low, around in zip(vectors, floors, every):
            q = np.append(np.asarray(x, np.float64), 0.0)
            base = float(q @ q) + square
            at = pivots.get(len(x))
            near = np.zeros(1) if at is None else _distances(at, q)
            top = [(base - max(near[r["region"]] - r["radius"], 0) ** 2) / 2 + ROUNDING * base + 1e-6 for r in around]
            out.append([{"region": r["region"], "salts": r["salts"]} for r, t in zip(around, top) if t >= low])
        return pd.Series(out, dtype=object)

    rest = rest.join(bounds, "dim").select("vec_id", "ints", "dim", "block", "floor", F.col("region").alias("home"), F.col("salt").alias("home_salt"), F.explode(reachable("ints", "floor", "all")).alias("r"))
    rest = rest.select("*", F.col("r.region").alias("region"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("r.salts") - 1)).alias("salt"))
    rest = rest.where("not (region = home and salt = home_salt)").select("vec_id", "ints", "dim", "region", "salt", "block", "floor")
    every = first.union(stored(answers(rest), "second")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
