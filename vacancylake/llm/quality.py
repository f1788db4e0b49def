"""Quality classifier: a sparse rule ensemble. Tree paths become conjunctive rules over text statistics, a lasso logistic
regression weighs them, and the rules that keep a weight are compiled into one Spark column expression."""
from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.common import fold, stored

THRESHOLD = 0.3
TRAIN_ROWS = 200_000  # bound on labelled rows to fit on; a hash sample beyond it
TREES, DEPTH, LASSO = 20, 3, 5e-4


def statistics(text: Column) -> dict[str, Column]:
    """Name to value (double) of each statistic; null counts as the empty text, for which all are 0.

    Quantifiers are possessive where a word could be tried again from its middle, so a word of any length is read once.
    """
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.regexp_count(t, F.lit(r"\S+")).cast("double")
    some = F.greatest(words, F.lit(1.0))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    return {
        "log_words": F.log1p(words),
        "word_length": F.length(t) / some,
        "upper_share": count(r"\p{Lu}") / n,
        "all_upper_words": count(r"(?<!\S)\p{Lu}{2,}+[^\p{Ll}\s]*+(?!\S)") / some,
        "symbol_share": count(r"[^\p{L}\p{N}\s.,;:'\"()?-]") / n,
        "symbol_words": count(r"(?<!\S)[^\p{L}\p{N}\s]++(?!\S)") / some,
        "doubled_words": count(r"(?<!\S)(\S++)\s++(?=\1(?!\S))") / some,
        "digit_share": count(r"[0-9]") / n,
        "stop_share": count(r"[.!?](?=\s|$)") / some,
        "comma_share": count(r"[,;:]") / some,
        "line_share": count(r"\n") / some,
    }


Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold
Rule = tuple[Condition, ...]


def tree_paths(node, names: list[str], path: Rule = ()) -> list[Rule]:
    """Paths from the root to every node below it."""
    if "Internal" not in node.getClass().getSimpleName():
        return [path] if path else []
    name, at = names[node.split().featureIndex()], float(node.split().threshold())
    return (([path] if path else []) + tree_paths(node.leftChild(), names, (*path, (name, "<=", at)))
            + tree_paths(node.rightChild(), names, (*path, (name, ">", at))))


def simplified(rule: Rule) -> Rule:
    """One bound for each statistic and side, the narrowest."""
    best: dict[tuple[str, str], float] = {}
    for name, side, at in rule:
        old = best.get((name, side), at)
        best[name, side] = min(old, at) if side == "<=" else max(old, at)
    return tuple(sorted((n, s, v) for (n, s), v in best.items()))


def holds(rule: Rule, stats: dict[str, Column]) -> Column:
    test = F.lit(True)
    for name, side, at in rule:
        test = test & (stats[name] <= at if side == "<=" else stats[name] > at)
    return test


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self, stats: dict[str, Column]) -> Column:
        """Probability of label 1 as a column expression."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def statistics_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, statistics), written once; texts are read a single time."""
    return stored(docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(k) for k, c in statistics(F.col(text)).items()]), "stats")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS, seed: int = 7) -> RuleEnsemble:
    """Learns from labelled rows whose fold is not 0.

    At most about max_rows rows are used (a sample by hash of the id beyond that). A document with several labels
    counts with the largest; null ids and labels are left out. Without rows of both classes the ensemble has no rule
    and scores everything with the smoothed share of label 1 (0.5 without any label).
    """
    names = [c for c in stats.columns if c != "doc_id"]
    known = labels.select(F.col("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    train = stored(stats.join(known, "doc_id").select("doc_id", "label", *names), "train")
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n > max_rows:
        train = train.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    if min(ones, n - ones) < 1:
        share = (ones + 1) / (n + 2)
        return RuleEnsemble((), float(-_logit(1 - share)))
    train = train.repartition(max(1, min(8, n // 5000)), "doc_id").sortWithinPartitions("doc_id", *names)  # the same rows in the same order give the same trees
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(train).select("label", "features").cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="0.6", seed=seed).fit(vectors)
    vectors.unpersist()
    paths = [p for k in range(TREES) for p in tree_paths(forest._java_obj.trees()[k].rootNode(), names)]
    rules = sorted({simplified(p) for p in paths})
    if not rules:
        return RuleEnsemble((), float(_logit((ones + 1) / (n + 2))))
    stat = {c: F.col(c) for c in names}
    binary = train.select("label", F.array(*[holds(r, stat).cast("double") for r in rules]).alias("r"))
    binary = binary.select("label", array_to_vector("r").alias("features")).cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=40, tol=1e-4, standardization=False).fit(binary)
    binary.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9), float(lasso.intercept))


def _logit(p: float) -> float:
    return log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    held_out marks ids whose fold is 0; labels of these are never learnt. Null and empty texts are scored like any
    other (all statistics 0). Rows with a null id are scored too, with held_out null. Repeated rows each get a row.
    Other columns of docs are not read. An empty table gives an empty result.
    """
    stats = statistics_table(docs)
    model = fit(stats, labels)
    score = model.score({c: F.col(c) for c in stats.columns if c != "doc_id"})
    made = stats.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns unchanged.

    Texts are measured once, in the stored statistics; rejected rows are found again by id and the text's hash.
    """
    stats = _keyed_statistics(docs)
    names = list(statistics(F.lit("")))
    model = fit(stats.select("doc_id", *names), labels)
    score = model.score({c: F.col(c) for c in names})
    gone = stats.where(score < threshold).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_text"]), "left_anti")


def _keyed_statistics(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", F.xxhash64("text").alias("text_key"), *[c.alias(k) for k, c in statistics(F.col("text")).items()]), "stats")
