import hashlib
from collections import Counter

import numpy as np

from vacancylake.llm import cws


def alike(a, b):
    a, b = cws.terms(a), cws.terms(b)
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def plain(docs, samples=cws.SAMPLES):
    """All rows in order, one by one, on the driver."""
    rows = sorted(docs, key=lambda r: r[0])
    sampler, out = cws.Sampler(samples), {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, other, following = (sampler.fingerprint(cws.terms(t)) for t in (text, edited, after))
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes(), other.tobytes(), cws.likeness(own, other), cws.likeness(own, following))
    return out


def answers(df):
    return {r[0]: (r[1], r[2], bytes(r[3]), bytes(r[4]), r[5], r[6]) for r in df.collect()}


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}ä" if i % 7 == 0 else f"W{i}" for i in range(300)]
    return [" ".join(words[min(299, int(k))] for k in rng.exponential(40, rng.integers(1, 120))) for _ in range(n)]


def test_collisions_follow_weighted_jaccard():
    made = texts(60)
    sampler = cws.Sampler(2048)
    for a, b in zip(made, [" ".join(t.split()[: len(t.split()) // 2 + 1]) for t in made]):
        got = cws.likeness(sampler.fingerprint(cws.terms(a)), sampler.fingerprint(cws.terms(b)))
        assert abs(got - alike(a, b)) < 0.06


def test_weights_count_not_only_terms():
    sampler = cws.Sampler(4096)
    a, b = {b"x": 9.0, b"y": 1.0}, {b"x": 1.0, b"y": 9.0}
    assert abs(cws.likeness(sampler.fingerprint(a), sampler.fingerprint(b)) - 2 / 18) < 0.03
    assert abs(cws.likeness(sampler.fingerprint({b"x": 0.5}), sampler.fingerprint({b"x": 2.5})) - 0.2) < 0.03


def test_memory_of_terms_changes_nothing():
    made = texts(30)
    small, large = cws.Sampler(64, cached=1), cws.Sampler(64)
    many = Counter({f"t{i}".encode(): 1 + i % 5 for i in range(3 * cws.TERMS)})
    for weights in [*map(cws.terms, made), many, *map(cws.terms, made[:3])]:
        assert (small.fingerprint(weights) == large.fingerprint(weights)).all()
    assert small.light.size == 2 * cws.TERMS < len(many)
    assert (large.fingerprint(dict(reversed(list(many.items())))) == large.fingerprint(many)).all()


def test_same_as_row_by_row(spark):
    rows = [(7 * i + 2 ** 60, t) for i, t in enumerate(texts(90))]
    rows[3] = (rows[3][0], None)
    rows[4] = (rows[4][0], "")
    rows[5] = (rows[5][0], "\U0001F600ß" * 3)
    rows[60] = (rows[60][0], rows[61][1])
    rows.append((-5, "long " * 60_000 + "x" * 100_000))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = answers(cws.compare_with_next(df))
    assert got == plain(rows)
    assert got[rows[60][0]][5] == 1.0 and got[rows[60][0]][2] == got[rows[61][0]][2]


def test_one_row_none_and_clashing_columns(spark):
    one = spark.createDataFrame([(4, "a b c d", 1, "z", 9, "h")], "doc_id long, text string, part int, guest string, place int, hash string")
    assert answers(cws.compare_with_next(one)) == plain([(4, "a b c d")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert cws.compare_with_next(empty).collect() == []


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b"), (None, None), (1, "c d e"), (1, "c d e"), (1, "c d f"), (2, "g")] * 2
    got = cws.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sorted(Counter(r[0] for r in got).items(), key=str) == [(1, 6), (2, 2), (None, 4)]
    sampler = cws.Sampler()
    of = lambda t: sampler.fingerprint(cws.terms(t)).tobytes()
    assert Counter(bytes(r[3]) for r in got) == Counter(of(t or "") for _, t in rows)


def test_columns_of_fingerprints(spark):
    df = spark.createDataFrame([("A b",), ("a  B",), (None,)], "text string")
    a, b, c = (bytes(r[0]) for r in df.select(cws.fingerprint_column(df["text"])).collect())
    assert a == b and len(a) == 2 * cws.SAMPLES and c == b""
