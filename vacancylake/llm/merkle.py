"""Merkle manifest of a table: distributed binary hash trees, one per group, whose versions copy only paths.

Leaves are cut into aligned blocks of a power of two, so a block is a whole subtree; block tops are the leaves of the next
tier. A version (one changed leaf) shares every untouched node: within its block only the changed leaf's ancestors are
copied, and above it the copy goes on as a join with the stored paths of the upper tiers.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.common import numbered, stored

BLOCK = 1024  # leaves of a block, a power of two
NODE = "tree string, pos long, total long, digest string, path array<string>, top string"


def record_digest(values: Sequence[Column]) -> Column:
    """sha256 (hex) of the values in order: `-` for null, else its UTF-8 byte count, `:`, and the value as text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _join(left: str, right: str) -> str:
    return sha256((left + right).encode()).hexdigest()


def _levels(digests: list[str], depth: int) -> list[list[str]]:
    """Levels of a block from its leaves up; a node without a partner is hashed alone."""
    levels = [digests]
    for _ in range(depth):
        last = levels[-1]
        levels.append([_join(last[i], last[i + 1] if i + 1 < len(last) else "") for i in range(0, len(last), 2)])
    return levels


def _depth(total: int, block: int) -> int:
    """Levels above a block's leaves: all of a small tree, else those of a full block."""
    return (min(int(total), block) - 1).bit_length()


def _sibling(level: list[str], i: int) -> str:
    """Side and digest of the other node of a pair; empty if the node is alone."""
    other = i ^ 1
    return ("R" if other > i else "L") + level[other] if other < len(level) else ""


def _step(node: str, sibling: str) -> str:
    return _join(sibling[1:], node) if sibling[:1] == "L" else _join(node, sibling[1:])


def _blocks(nodes: DataFrame, block: int) -> DataFrame:
    """Nodes with the siblings up to the top of their block, and that top."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        levels = _levels(part["digest"].tolist(), _depth(part["total"].iloc[0], block))
        part["path"] = [[_sibling(level, i >> j) for j, level in enumerate(levels[:-1])] for i in range(len(part))]
        part["top"] = levels[-1][0]
        return part[["tree", "pos", "total", "digest", "path", "top"]]

    keyed = nodes.select("tree", "pos", "total", "digest", F.expr(f"pos div {block}").alias("block"))
    return keyed.groupBy("tree", "block").applyInPandas(run, NODE)


def _tops(rows: DataFrame, block: int) -> DataFrame:
    return rows.where(F.col("pos") % block == 0).select("tree", F.expr(f"pos div {block}").alias("pos"), F.expr(f"(total + {block - 1}) div {block}").alias("total"), F.col("top").alias("digest"))


def _climb(nodes: DataFrame, block: int) -> DataFrame:
    """(tree, pos, path, root): siblings of each node up to the root of its tree, tier by tier."""
    rows = stored(_blocks(nodes, block), "tier")
    if (rows.agg(F.max("total")).first()[0] or 0) <= block:
        return rows.select("tree", "pos", "path", F.col("top").alias("root"))
    up = _climb(_tops(rows, block), block).select("tree", F.col("pos").alias("up"), F.col("path").alias("more"), "root")
    made = rows.withColumn("up", F.expr(f"pos div {block}")).join(up, ["tree", "up"])
    return stored(made.select("tree", "pos", F.concat("path", "more").alias("path"), "root"), "paths")


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf and its siblings give."""
    other = lambda s: F.substring(s, 2, 64)
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.when(s.startswith("L"), F.concat(other(s), node)).otherwise(F.concat(node, other(s))), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings' digests, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """leaves: (tree, pos, total, digest, path, top), path and top within the block. above: (tree, up, more, subroot, root),
    the siblings from a block's top through the subroot of its tree to the root over all trees."""
    leaves: DataFrame
    above: DataFrame
    block: int

    def proofs(self) -> DataFrame:
        """(tree, pos, digest, path, subroot, root): every leaf with its siblings up to the root."""
        return self._up(self.leaves).select("tree", "pos", "digest", F.concat("path", "more").alias("path"), "subroot", "root")

    def versions(self, changes: DataFrame) -> DataFrame:
        """(version, tree, pos, copies, version_root): a version for each row (version, tree, pos, digest) of changes.

        copies holds the nodes that this version has of its own, from the changed leaf's parent up to its root (the leaf
        itself, if there is no node above it); all others are those of the manifest. Changes of no leaf make no version.
        """
        block = self.block

        def copy(base: pd.DataFrame, changed: pd.DataFrame) -> pd.DataFrame:
            out = []
            if not len(base):
                return pd.DataFrame(out, columns=["version", "tree", "pos", "copies", "node"])
            base = base.sort_values("pos")
            levels = _levels(base["digest"].tolist(), _depth(base["total"].iloc[0], block))
            first = base["pos"].iloc[0]
            for version, tree, pos, node in zip(changed["version"], changed["tree"], changed["pos"], changed["digest"]):
                i, own = int(pos - first), []
                if not 0 <= i < len(levels[0]):
                    continue
                for j, level in enumerate(levels[:-1]):
                    node = _step(node, _sibling(level, i >> j))
                    own.append(node)
                out.append((version, tree, pos, own, node))
            return pd.DataFrame(out, columns=["version", "tree", "pos", "copies", "node"])

        at = F.expr(f"pos div {block}").alias("block")
        base = self.leaves.select("tree", "pos", "total", "digest", at).groupBy("tree", "block")
        new = changes.select("version", "tree", "pos", "digest", at).groupBy("tree", "block")
        kind = changes.schema["version"].dataType.simpleString()
        made = base.cogroup(new).applyInPandas(copy, f"version {kind}, tree string, pos long, copies array<string>, node string")
        grown = F.aggregate("more", F.array("node"), lambda own, s: F.concat(own, F.array(fold(F.element_at(own, -1), F.array(s)))))
        made = self._up(made).withColumn("grown", grown)
        return made.select("version", "tree", "pos", F.concat("copies", F.slice("grown", F.lit(2), F.greatest(F.size("grown") - 1, F.lit(0)))).alias("copies"), F.element_at("grown", -1).alias("version_root"))

    def _up(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("up", F.expr(f"pos div {self.block}")).join(self.above, ["tree", "up"])


def build(nodes: DataFrame, block: int = BLOCK) -> Manifest:
    """Manifest over leaves (tree, pos, total, digest): pos counts from 0 within a tree of total leaves. Trees are ordered by name."""
    if block < 2 or block & block - 1:
        raise ValueError("block must be a power of two")
    leaves = stored(_blocks(nodes, block), "leaves")
    tops = _climb(_tops(leaves, block), block)
    subroots = numbered(tops.where("pos = 0").select("tree", F.col("root").alias("digest")), ["tree"])
    forest = _climb(subroots.select(F.lit("").alias("tree"), "pos", "total", "digest"), block)
    forest = subroots.select("tree", "pos", F.col("digest").alias("subroot")).join(forest.select("pos", F.col("path").alias("over"), "root"), "pos").drop("pos")
    above = tops.select("tree", F.col("pos").alias("up"), "path").join(forest, "tree").select("tree", "up", F.concat("path", "over").alias("more"), "subroot", "root")
    return Manifest(leaves, stored(above, "above"), block)


def tree_name(group: Column) -> Column:
    """Name of a group's tree; names sort as the groups do, bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def document_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", key: str = "doc_id", tampered: Column | None = None, changed: str = "n_chars", block: int = BLOCK) -> DataFrame:
    """(key, leaf, path, subroot, root, tampered_leaf, copies, version_root) per row of docs.

    Leaves of a group ascend by key (null first); rows that share a key ascend by their digest, and repeated rows are
    leaves of their own. Where `tampered` holds, a version is made whose leaf has `changed` plus 1 (a null stays null);
    the last three columns are null elsewhere. Null fields have a digest of their own, empty texts count 0 bytes. Only
    digests travel, never texts. Other columns are not read. An empty table gives no rows.
    """
    own = [F.col(f"`{f}`") for f in fields]
    other = [c + 1 if f == changed else c for f, c in zip(fields, own)]
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = docs.select(F.col(f"`{key}`").alias("key"), tree_name(F.col(f"`{group}`")).alias("tree"), record_digest(own).alias("digest"), F.when(hit, record_digest(other)).alias("tampered_leaf"), F.monotonically_increasing_id().alias("spread"))
    rows = numbered(rows, ["key", "digest", "spread"], within="tree")
    made = build(rows, block)
    versions = made.versions(rows.where("tampered_leaf is not null").select(F.col("key").alias("version"), "tree", "pos", F.col("tampered_leaf").alias("digest")))
    proofs = made.proofs().join(rows.select("tree", "pos", "key", "tampered_leaf"), ["tree", "pos"])
    proofs = proofs.join(versions.drop("version"), ["tree", "pos"], "left")
    return proofs.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "path", "subroot", "root", "tampered_leaf", "copies", "version_root")
