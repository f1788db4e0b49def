import random
import zlib

import pytest
from pyspark.sql import functions as F

from vacancylake.llm import language, quality

RNG = random.Random(5)
WORDS = {"en": "the of and to house river stone light".split(), "de": "der und über straße haus fluß stein licht".split()}


def prose(lang, n=60):
    return " ".join(RNG.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def test_quality_learns_the_labels_outside_the_fold(spark, documents):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, (prose("en").upper().replace(" ", "!! ") if bad else prose("en"))))
        labels.append((i, 0 if bad else 1))
    odd = [(1000, None), (1001, ""), (None, "no id here"), (1002, "word " * 60000), (0, rows[0][1])]
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.classify(documents(rows + odd), lab).collect()
    assert len(got) == 405
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert sum(by[i]["predicted"] == q for i, q in labels) >= 396
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    flipped = spark.createDataFrame([(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in labels], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in quality.classify(documents(rows + odd), flipped).collect()}
    assert all(again[i] == pytest.approx(by[i]["score"]) for i in range(400))  # labels of the fold are never learnt


def test_quality_without_usable_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.classify(documents([(1, "a")]), none).collect()] == [0.5]
    assert quality.classify(documents([]), none).count() == 0
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality.classify(documents([(i, "text") for i in range(20)]), ones).collect())


def test_keep_good_leaves_rows_unchanged(spark):
    df = spark.createDataFrame([(i, prose("en") if i % 3 else "###$$$ " * 50, i) for i in range(120)], "doc_id long, text string, word_length long")
    lab = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(120)], "doc_id long, quality int")
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(120) if i % 3]


def test_statistics_of_a_million_capitals(documents):
    texts = ["A" * 1_000_000 + "b", "!" * 1_000_000 + "b", "A" * 1_000_000 + " AB1 ABc !!", "x " * 300_000 + "x"]
    rows = documents(list(enumerate(texts))).select(*[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).collect()
    assert rows[0]["all_upper_words"] == 0 and rows[1]["symbol_words"] == 0
    assert rows[2]["all_upper_words"] == 2 / 4 and rows[2]["symbol_words"] == 1 / 4
    assert rows[3]["doubled_words"] > 0.9


def test_rules_are_narrowed():
    rule = (("a", "<=", 3.0), ("a", "<=", 2.0), ("b", ">", 1.0), ("b", ">", 4.0))
    assert quality.simplified(rule) == (("a", "<=", 2.0), ("b", ">", 4.0))


def test_language_held_out_accuracy(documents):
    rows = [(i, prose("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(200)]
    odd = [(500, None, "en"), (501, "", "en"), (502, "12 34 !?", "de"), (503, "日本", None), (None, prose("de"), "de"), (504, prose("en", 30000), None)]
    docs = documents(rows + odd)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, language.training_sample(docs)).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert got[503][0] in ("en", "de") and got[None][0] == "de" and got[504][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_without_samples(documents):
    assert language.training_sample(documents([(1, "abc", None)])) == {}
    assert [r["lang_pred"] for r in language.identify(documents([(1, "abc")]), {}).collect()] == ["und"]
    assert language.identify(documents([]), {"en": "abc"}).count() == 0


def phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at:at + k + 1] in sample:
            k += 1
        if text[at] not in sample:
            k = 1
        n, at = n + 1, at + k
    return n


def test_phrase_counts_are_those_of_plain_search():
    samples = (("x", "abracadabra banana"), ("y", "the rain in spain"))
    own = language.Parser(samples)
    texts = ["banana bread", "in the brain", "zzz", "abra cad abra", "spain"]
    cost, _ = own.costs(texts)
    for k, (_, s) in enumerate(samples):
        got = cost[:, k] / own.weights[k]
        for t, g in zip(texts, got):
            # every miss starts a phrase with the missed letter; letters without a match count as one
            assert abs(g - phrases(t, s)) <= 1 + sum(c not in s for c in t)


def test_every_letter_of_large_scripts_counts(documents):
    rng = random.Random(9)
    latin, greek, cyrillic = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюяѓќљњџіїєґ"
    han = [chr(0x4E00 + i) for i in range(3000)]

    def maker(letters, n, words):
        own = ["".join(rng.choices(letters, k=n)) for _ in range(words)]
        return lambda k: " ".join(rng.choices(own, k=k))

    # pairs of languages share a script and differ by their words alone
    make = {"en": maker(latin, 5, 300), "de": maker(latin, 5, 300), "el": maker(greek, 5, 300), "el2": maker(greek, 5, 300), "ru": maker(cyrillic, 5, 300), "uk": maker(cyrillic, 5, 300),
            "zh": maker(han, 3, 1500), "ja": maker(han, 3, 1500)}
    rows = [(1000 * i + j, m(200 if j else 2), k) for i, (k, m) in enumerate(make.items()) for j in range(40)]
    docs = documents(rows)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.training_sample(docs)).collect()}
    wrong = [(i, lang, got[i]) for i, _, lang in rows if i % 1000 and got[i] != lang]
    assert not wrong, wrong[:5]


def test_phrase_counts_with_many_letters():
    rng = random.Random(10)
    han = [chr(0x4E00 + i) for i in range(400)]
    words = ["".join(rng.choices(han, k=4)) for _ in range(200)]
    sample = "".join(words + rng.choices(words, k=400))
    own = language.Parser((("zh", sample), ("x", "abc")))
    assert len(own.tables[0]) // language.WIDTH > 600
    for text in ["".join(rng.choices(words, k=30)) for _ in range(20)]:
        cost, _ = own.costs([text])
        assert abs(cost[0, 0] / own.weights[0] - phrases(text, sample)) <= 1, text
        assert cost[0, 1] / own.weights[1] == 1 + len(text)
