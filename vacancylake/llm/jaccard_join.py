"""Exact self-join of word-shingle sets at Jaccard similarity 0.8: pivots, Voronoi regions, triangle-inequality windows.

Plain data pivots do not part this space: almost all texts lie at distance 1 from any text. So the first level uses
pivots of its own: every shingle of a set's prefix (see shingles.prefix) belongs to one pivot set, the smallest-keyed set
that has it in its prefix, and a set lies in the region of each pivot it shares such a shingle with. Linked sets share
a part of their prefix, hence a region; sets whose prefix is mostly theirs alone leave here. Inside a region, true Jaccard distances to
pivots, regions of the nearest pivot with boundary copies, and recursion do the rest (shingles.region_links). Regions too
large for a task are first cut by their distance to a central member and by size, both in windows that no link leaves.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from vacancylake.llm import shingles
from vacancylake.llm.common import bounded_batches, components, stored

SAMPLE_DOCS, SEEN, FREQUENT = 10_000, 3, 200_000  # documents that frequent shingles are looked for in, times seen, list length
REGION, TASK = 2_000_000, 500_000  # shingles in all sets of a region that one task joins; of a task with several regions
ROWS = 4_000  # sets of a region that one task joins; of a block
RING, STEP = 0.2 + 1e-6, float(np.log(1.25)) + 1e-6  # no link spans more than one ring of distances or one step of sizes


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rank by frequency) of shingles that a bounded sample of documents shows often.

    The list only chooses the order in which prefixes take shingles. Any list gives the same result; a good one keeps
    passages that many documents share out of the prefixes.
    """
    total = docs.count()
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(ArrayType(LongType()))
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles.shingle_set(t) for t in texts], dtype=object)

    share = min(1.0, SAMPLE_DOCS / total)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    often = some.select(F.explode(sets("text")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    rows = often.orderBy(F.desc("n"), "s").limit(FREQUENT).collect()
    own, n = np.array([r["s"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(own)
    return own[order], n[order]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, sk, prefix): size, name and prefix of each row's set; sk is null for empty sets and null ids."""
    often, rank = frequent_shingles(docs)

    @F.pandas_udf(StructType().add("n", "long").add("sk", "long").add("prefix", ArrayType(LongType())))
    def describe(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles.shingle_set(t) for t in texts]
        return pd.DataFrame({"n": [len(s) for s in sets], "sk": [shingles.set_key(s) for s in sets],
                             "prefix": pd.Series([shingles.prefix(s, often, rank) for s in sets], dtype=object)})

    made = docs.select("doc_id", F.xxhash64("text").alias("text_key"), describe("text").alias("d"))
    real = (F.col("d.n") > 0) & F.col("doc_id").isNotNull()
    return stored(made.select("doc_id", "text_key", F.col("d.n").alias("n_shingles"), F.when(real, F.col("d.sk")).alias("sk"), F.when(real, F.col("d.prefix")).alias("prefix")), "described")


def region_members(feats: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((p, sk): which set lies in which region; (p, members, weight, center): regions of two or more sets).

    A set of n leaves if it shares fewer than r = 1 + 0.8 n / 20 of its prefix elements with anyone: linked sets share
    that many (see shingles.prefix). For the same reason it may leave its last regions, in an order that all sets use,
    as long as fewer than r of its elements lie there; the order puts large regions last. It also leaves a region
    that has no other set of a size between 0.8 and 1.25 of its own. The center is the member with the largest share of
    its prefix in common with others: in a group of copies with edits of their own that is the text they come from.
    """
    postings = feats.where("sk is not null").select(F.explode("prefix").alias("s"), "sk")
    shared = postings.groupBy("s").agg(F.min("sk").alias("p"), F.max("sk").alias("other")).where("p <> other").select("s", "p")
    held = postings.join(stored(shared, "shared"), "s").groupBy("p", "sk").agg(F.count("*").alias("hits"))
    held = stored(held.join(classes, "sk").select("p", "sk", "n", (F.col("hits") / F.col("copies")).alias("hits")), "held")
    size = held.groupBy("p").agg(F.sum("n").alias("size"))
    own = Window.partitionBy("sk")
    before = F.coalesce(F.sum("hits").over(own.orderBy("size", "p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    n = F.col("n")
    sized = held.join(size, "p").select("p", "sk", "n", F.sum("hits").over(own).alias("all"), before.alias("before"), F.floor(F.log(n) / STEP).alias("step"))
    kept = stored(sized.where(F.col("all") - F.col("before") >= 1 + F.floor(F.floor((4 * n + 4) / 5) / 20)), "kept")
    cells = kept.groupBy("p", "step").agg(F.count("*").alias("count")).select("p", "step", "count", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("move"))
    others = cells.groupBy("p", (F.col("step") + F.col("move")).alias("step")).agg(F.sum(F.when(F.col("move") == 0, F.col("count") - 1).otherwise(F.col("count"))).alias("others"))
    need = n - F.floor((4 * n + 4) / 5) + 1 + F.floor(n / 20)
    members = stored(kept.join(others.where("others > 0"), ["p", "step"]).select("p", "sk", "n", (F.col("all") / need).alias("common")), "members")
    regions = members.groupBy("p").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.max_by("sk", F.struct("common", "n", "sk")).alias("center"))
    return members.select("p", "sk"), stored(regions.where("members > 1"), "regions")


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sk, own): the whole sets, as bytes, of the classes in wanted (sk, rep).

    wanted grows with the corpus, so the join is a merge at any size; its texts are stored before sets are made of them,
    as the planner would otherwise make the sets of all texts first.
    """
    @F.pandas_udf(StructType().add("sk", "long").add("own", "binary"))
    def whole(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles.shingle_set(t) for t in texts]
        return pd.DataFrame({"sk": [shingles.set_key(s) for s in sets], "own": [s.tobytes() for s in sets]})

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted.withColumnRenamed("sk", "named").hint("merge"), "rep")
    made = stored(texts.select("named", "text"), "texts").select("named", whole("text").alias("w"))
    return stored(made.where("named = w.sk").select("w.sk", "w.own").dropDuplicates(["sk"]), "sets")


def _links(part: pd.DataFrame) -> pd.DataFrame:
    """Links within each group of a task: rows (cell, sk, own, joined)."""
    out = []
    for _, rows in part.groupby("cell", sort=False):
        keys = rows["sk"].to_numpy()
        found = shingles.region_links([_array(x) for x in rows["own"]], tuple(np.flatnonzero(rows["joined"].to_numpy()).tolist()))
        out += [(keys[a], keys[b]) for a, b in found]
    return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)


def too_large() -> Column:
    """Whether a region has more shingles or more sets than one task joins."""
    return (F.col("weight") > REGION) | (F.col("members") > ROWS)


def small_links(members: DataFrame, regions: DataFrame, sets: DataFrame) -> DataFrame:
    """Links in the regions that one task can hold, several regions to a task."""
    own = regions.where(~too_large())
    tasks = max(1, int((own.agg(F.sum("weight")).first()[0] or 0) // TASK))
    rows = members.join(own.select("p"), "p").join(sets, "sk").select(F.col("p").alias("cell"), "sk", "own", F.lit(False).alias("joined"), F.pmod(F.xxhash64("p"), F.lit(tasks)).alias("task"))
    return rows.groupBy("task").applyInPandas(_links, "a long, b long")


def large_links(members: DataFrame, regions: DataFrame, sets: DataFrame) -> DataFrame:
    """Links in the other regions. Sets linked to the center are joined by that; the rest, and those near enough to one
    of them, meet in cells of distance rings and size steps. A cell still too large is dealt to tasks by pairs of blocks."""
    big = regions.where(too_large()).select("p", "center")
    centers = big.join(sets.withColumnRenamed("sk", "center").withColumnRenamed("own", "center_set"), "center").select("p", "center", "center_set")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(map(_array, a), map(_array, b)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(1 - both / (len(x) + len(y) - both))
        return pd.Series(out, dtype=float)

    away = stored(members.join(big.select("p"), "p").join(sets, "sk").join(centers, "p").select("p", "sk", "center", "own", distance("own", "center_set").alias("d")), "away")
    linked = F.col("d") <= 0.2 + 1e-12
    star = away.where(linked & (F.col("sk") != F.col("center"))).select(F.col("sk").alias("a"), F.col("center").alias("b"))
    least = away.where(~linked).groupBy("p").agg(F.min("d").alias("least"))
    rest = away.join(least, "p").where(~linked | (F.col("d") >= F.col("least") - 0.2 - 1e-9))
    rest = rest.select("p", "sk", "own", linked.alias("joined"), F.floor(F.col("d") / RING).alias("ring"), F.floor(F.log(F.length("own") / 8.0) / STEP).alias("step"))
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(s).alias("s")) for r, s in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    cells = rest.select("p", "sk", "own", "joined", "ring", "step", F.explode(moves).alias("m")).select("p", "sk", "own", "joined", (F.col("ring") + F.col("m.r")).alias("ring"), (F.col("step") + F.col("m.s")).alias("step"))
    cell = ["p", "ring", "step"]
    blocks = cells.groupBy(cell).agg(F.greatest(F.ceil(F.sum(F.length("own")) / (8.0 * REGION)), F.ceil(F.count("*") / ROWS)).alias("blocks"))
    dealt = cells.join(blocks, cell).withColumn("mine", F.pmod(F.xxhash64("sk"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64(*cell).alias("cell"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "sk", "own", "joined")
    return star.union(dealt.groupBy("cell", "i", "j").applyInPandas(_links, "a long, b long"))


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key), one row for each row of docs; text_key is xxhash64 of the text.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set has the distinct runs of five words, or the
    whole sequence if there are fewer. Two documents link when 100 * |intersection| >= 80 * |union|; component_id is the
    smallest doc_id reachable by links. Equal sets are one node. Null, empty and blank texts have an empty set, link with
    nothing and are their own component; a null id has a null component and links with nothing. Rows that repeat an id
    with different texts are separate rows of one document: their links count for the id, and each row gets its own
    set's component. Very long texts count whole. Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    feats = described(docs)
    classes = stored(feats.where("sk is not null").groupBy("sk").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")), "classes")
    members, regions = region_members(feats, classes)
    wanted = members.join(regions.select("p"), "p").select("sk").distinct().join(classes.select("sk", "rep"), "sk")
    sets = candidate_sets(docs, stored(wanted, "wanted"))
    links = small_links(members, regions, sets)
    if regions.where(too_large()).limit(1).count():
        links = links.union(large_links(members, regions, sets))
    names = classes.select("sk", "rep")
    edges = links.distinct().join(names.withColumnRenamed("sk", "a").withColumnRenamed("rep", "ra"), "a").join(names.withColumnRenamed("sk", "b").withColumnRenamed("rep", "rb"), "b")
    labels = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    known = names.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("sk", F.coalesce("label", "rep").alias("component"))
    made = feats.select("doc_id", "n_shingles", "sk", "text_key").join(known, "sk", "left")
    return made.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "text_key")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are the first of their group (component_id = doc_id), all columns unchanged.

    Blank texts and rows with a null id stay. Rows that repeat an id and its text stay together.
    """
    groups = jaccard_groups(docs, doc_id, text)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text")).distinct()
    return docs.join(gone, (docs[doc_id].cast("long") == gone["gone_id"]) & (F.xxhash64(docs[text]) == gone["gone_text"]), "left_anti")
