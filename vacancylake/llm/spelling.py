"""Spelling variants of a corpus' words: exact one-edit neighbours through PartEnum signatures.

A word is a binary vector over (letter, occurrence). One edit changes at most two of its places, so with the letters dealt
to CLASSES classes, some choice of CLASSES - 2 classes holds all that two near words share. A signature is the word's
letters of one choice, sorted; near words have at least one signature in common. Words of six or more letters that differ by
one edit also share their first or their last three letters, which are part of the join key. Joined pairs are verified.
"""
from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.common import LOWER, UPPER, stored

LETTERS = "A-Za-zÀ-ÿ"
ALPHABET = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
CLASSES = 6  # letter classes; a signature leaves out two of them
CHANGED = 2  # places of the vectors of near words that differ, at most
AFFIX = 3  # letters at either end of which one is untouched by an edit
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
SLIP = 199  # runs whose hash this divides lose a letter


def lowered(run: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def with_slips(run: Column, doc_id: Column) -> Column:
    """The run, without one letter where its hash with the document says so. A null id counts as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): letter runs of all texts, counted after with_slips; counts are summed per task before the shuffle."""
    runs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("run"))
    made = runs.select(with_slips(lowered(F.col("run")), F.col("doc_id")).alias("word")).where(F.length("word") >= least_letters)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_classes(vocabulary: DataFrame, classes: int = CLASSES) -> list[str]:
    """The letters dealt to classes of about equal weight. Any deal gives the same pairs, a fair one the fewest candidates."""
    counts = dict(vocabulary.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().where(F.col("c").isin(ALPHABET)).collect())
    made, load = [""] * classes, [0] * classes
    for c in sorted(ALPHABET, key=lambda c: (-counts.get(c, 0), c)):
        k = load.index(min(load))
        made[k] += c
        load[k] += counts.get(c, 0) + 1
    return made


def signatures(vocabulary: DataFrame, classes: list[str]) -> DataFrame:
    """(key, word, n): a row for each choice of classes and each end of the word."""
    ordered = F.array_join(F.array_sort(F.split("word", "")), "")
    sets = [F.translate("ordered", "".join(out), "") for out in combinations(classes, CHANGED)]
    ends = [F.concat(F.lit("<"), F.substring("word", 1, AFFIX)), F.concat(F.lit(">"), F.expr(f"right(word, {AFFIX})"))]
    keys = [F.xxhash64(F.lit(j), s, e) for j, s in enumerate(sets) for e in ends]
    return vocabulary.withColumn("ordered", ordered).select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def shuffled(df: DataFrame) -> DataFrame:
    """The table as a side of a join that is never broadcast: Spark sizes it by its compressed files and takes an explode for one row per row."""
    return df.hint("merge")


def near_pairs(vocabulary: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(word, n, other, other_n), each unordered pair once: distinct words one insertion, deletion or replacement apart.

    Words need at least 2 * AFFIX letters. All pairs of one key are verified in the join; only near ones leave it.
    """
    made = signatures(vocabulary, letter_classes(vocabulary, classes))
    a, b = made.alias("a"), shuffled(made).alias("b")
    near = (F.abs(F.length("a.word") - F.length("b.word")) <= 1) & (F.levenshtein("a.word", "b.word", 1) == 1)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & near)
    return pairs.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct()


def variant_groups(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of vocabulary (word, n; distinct words of six or more letters).

    form is the near word of largest n (ties: the smallest in code-point order) if its n is at least ratio times the
    word's; root is where the chain of forms ends. ratio is 2 or more. An empty vocabulary gives no rows.
    """
    vocabulary = stored(vocabulary.select("word", "n"), "words")
    pairs = stored(near_pairs(vocabulary), "pairs")
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    made = vocabulary.join(shuffled(best), "word", "left")
    takes = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    made = stored(made.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "forms")
    hops = made.where("form is not null").select("word", "form")
    for _ in range(math.ceil(math.log2(63 / math.log2(ratio)))):  # counts below 2^63 that grow by ratio; each jump doubles the reach
        far = hops.select(F.col("word").alias("form"), F.col("form").alias("far"))
        hops = stored(hops.join(shuffled(far), "form", "left").select("word", F.coalesce("far", "form").alias("form")), "hops")
    return made.join(shuffled(hops.select("word", F.col("form").alias("root"))), "word", "left").withColumn("root", F.coalesce("root", "word"))


def corpus_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """variant_groups of the words of all whole texts. Null and empty texts hold no words; other columns are not read."""
    return variant_groups(words(docs, doc_id, text))
