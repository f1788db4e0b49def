import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from vacancylake.llm import merkle, queries


def h(text):
    return sha256(text.encode()).hexdigest()


def digest(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([h("".join(made[-1][i:i + 2])) for i in range(0, len(made[-1]), 2)])
    return made


def climb(tree, i, node):
    """(siblings, folded top) of leaf i."""
    others = []
    for level in tree[:-1]:
        run = list(level[i // 2 * 2:i // 2 * 2 + 2])
        own = i % 2
        others += run[:own] + run[own + 1:]
        run[own] = node
        node, i = h("".join(run)), i // 2
    return others, node


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) for rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for d, text, lang, source, n in rows:
        leaf = digest([d, source, lang, n, text])
        other = digest([d, source, lang, n if n is None else n + 1, text]) if d is not None and zlib.crc32(str(d).encode()) % 7 == 0 else leaf
        groups.setdefault(lang, []).append((d is not None, d, leaf, other))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in names:
        groups[lang].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        trees[lang] = levels([r[2] for r in groups[lang]])
    top = levels([trees[lang][-1][0] for lang in names])
    out = []
    for k, lang in enumerate(names):
        for i, (_, d, leaf, other) in enumerate(groups[lang]):
            low, node = climb(trees[lang], i, other)
            high, folded = climb(top, k, node)
            out.append((d, leaf, trees[lang][-1][0], top[-1][0], h("".join(low + high)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def answers(made):
    folded = F.coalesce("version_root", merkle.fold(F.col("leaf"), F.col("path")))
    return sorted((tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), folded, folded == F.col("root")).collect()), key=str)


def hit():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("block", [4, 1024])
def test_against_plain_tree(spark, block):
    langs = ["de"] * 37 + ["en"] * 16 + [None] * 5 + ["é"] + [""] * 3 + ["zh"] * 2
    rows = [(11 * i % 64 if i else 0, f"text {i} ü", lang, f"s{i % 3}" if i % 5 else None, i if i % 4 else None) for i, lang in enumerate(langs)]
    made = merkle.document_manifest(table(spark, rows).repartition(3), tampered=hit(), block=block)
    assert answers(made) == plain(rows)
    assert {r[6] for r in plain(rows)} == {True, False}


def test_versions_copy_only_the_path(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(45)]
    made = merkle.document_manifest(table(spark, rows), tampered=hit(), block=8).cache()
    tampered = made.where("tampered_leaf is not null").collect()
    assert tampered and made.where("tampered_leaf is null and (copies is not null or version_root is not null)").count() == 0
    for r in tampered:
        assert len(r["copies"]) == len(r["path"]) == 6 and r["copies"][-1] == r["version_root"] != r["root"]
    base = {x for level in levels([r["leaf"] for r in made.orderBy("doc_id").collect()]) for x in level}
    assert not base & {x for r in tampered for x in r["copies"]}
    again = made.where("tampered_leaf is not null").select((merkle.fold(F.col("tampered_leaf"), F.col("path")) == F.col("version_root")).alias("same"))
    assert all(r["same"] for r in again.collect())


def test_nulls_repeated_rows_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(7, "", None, "", 0)] * 2 + [(7, "x" * 300_000, None, "s", 1), (-(2 ** 62), "b", "en", None, None)]
    rows += [(i, None, "en", None, None) for i in range(30)]
    made = merkle.document_manifest(table(spark, rows).withColumn("tree", F.lit(1)).withColumn("path", F.lit("p")).withColumn("key", F.lit("k")), tampered=hit(), block=4)
    got = answers(made)
    assert got == plain(rows)
    assert all(r[6] for r in got if r[0] is not None and 0 <= r[0] < 7)  # tampering leaves null counts alone


def test_one_row_and_none(spark):
    one = [(3, "a", "en", "s", 1)]
    assert answers(merkle.document_manifest(table(spark, one), tampered=hit())) == plain(one)
    assert merkle.document_manifest(table(spark, []), tampered=hit()).collect() == []


def test_unknown_changes_make_no_version(spark):
    nodes = spark.createDataFrame([("t", i, 3, h(str(i))) for i in range(3)], "tree string, pos long, total long, digest string")
    made = merkle.build(nodes, 2)
    changes = spark.createDataFrame([("a", "t", 1, h("x")), ("b", "t", 9, h("x")), ("c", "u", 0, h("x")), ("d", "t", 1, h("y"))], "version string, tree string, pos long, digest string")
    got = {r["version"]: r["copies"] for r in made.versions(changes).collect()}
    assert set(got) == {"a", "d"} and got["a"] != got["d"] and len(got["a"]) == 2
    with pytest.raises(ValueError):
        merkle.build(nodes, 3)


def test_query(spark):
    assert queries.op13_merkle(spark, "/root/testdata/sf0.001").where("verified").count() > 0
