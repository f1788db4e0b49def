import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import regex

from vacancylake.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(counts, ratio=5):
    links = {w: [o for o in counts if near(w, o)] for w in counts}
    form = {}
    for w in counts:
        best = min(links[w], key=lambda o: (-counts[o], o.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(links[w]), form[w], counts.get(form[w]), root)
    return out


def groups(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def vocabulary(seed, size):
    """Words over few letters with many near neighbours, anagrams and repeated letters."""
    rng = np.random.default_rng(seed)
    made = set()
    while len(made) < size:
        w = "".join(rng.choice(list("abï"), rng.integers(6, 8)))
        made.add(w)
        if rng.random() < 0.6:
            i = rng.integers(0, len(w))
            made.add(w[:i] + rng.choice(list("abeïzÿÀ")) + w[i + rng.integers(0, 2):])
    return {w: int(5 * 6 ** rng.integers(0, 6)) + int(rng.integers(0, 3)) for w in sorted(made) if len(w) >= 6}


def test_near_pairs_against_all_pairs(spark):
    counts = vocabulary(3, 400)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {(r["word"], r["other"]) for r in spelling.near_pairs(df).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(counts), 2) if near(a, b)} and len(got) > 300


def test_groups_against_plain_version(spark):
    counts = vocabulary(4, 300)
    got = groups(spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain_groups(counts)
    assert any(r[4] not in (w, r[2]) for w, r in got.items())  # chains of two or more


def test_long_chain_and_ties(spark):
    word, counts = "aaaaaaaaaaaa", {}
    for i in range(9):
        counts["b" * i + word[i:]] = 5 ** (9 - i)
    counts |= {"qqqqqq": 5, "qqqqqx": 25, "qqqqqé": 25, "qqqqqy": 24}
    got = groups(spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain_groups(counts)
    assert got["bbbbbbbbaaaa"][4] == word and got["qqqqqq"][2] == "qqqqqx"


def test_words_of_documents(spark, documents):
    rng = np.random.default_rng(5)
    base = ["Wonderful", "wonderful", "Straße", "STRASSE", "Élevé", "élevé", "short", "x×y÷zéa", "gardening"]
    rows = [(int(i), " ".join(rng.choice(base, 60)) + ("9" if i % 3 else "\n_") + "l" * 40) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "ab" * 50_000), (903, "gardening " * 3), (903, "gardening " * 3)]
    counts = Counter()
    for i, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = groups(spelling.corpus_variants(documents(rows).withColumn("word", spelling.F.lit("w")).withColumn("n", spelling.F.lit("n"))))
    assert got == plain_groups(want) and any(r[2] for r in got.values())


def test_empty(spark, documents):
    assert spelling.corpus_variants(documents([])).collect() == []
    assert spelling.corpus_variants(documents([(1, None), (None, "wonder " * 5)])).select("word", "n").collect() == [("wonder", 5)]


def test_signatures_and_classes(spark):
    df = spark.createDataFrame([("wonder", 9)], "word string, n long")
    classes = spelling.letter_classes(df)
    assert sorted("".join(classes)) == sorted(spelling.ALPHABET) and len(classes) == spelling.CLASSES
    assert spelling.signatures(df, classes).count() == 30


def test_no_side_of_the_joins_is_broadcast(spark, monkeypatch):
    made, real = [], spelling.stored
    monkeypatch.setattr(spelling, "stored", lambda df, name="part": made.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    df = spark.createDataFrame(list(vocabulary(5, 60).items()), "word string, n long")
    made.append(spelling.variant_groups(df)._jdf.queryExecution().executedPlan().toString())
    # every table here is tiny, so Spark would broadcast each one, the exploded signatures too
    assert sum("Join" in p for p in made) > 3 and not any("BroadcastHashJoin" in p for p in made)
