"""Language identification by cross-parsing: a text is cut into the fewest phrases that occur in a language's sample."""
from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vacancylake.llm.common import bounded_batches, fold

SAMPLE_CHARS = 30_000  # training characters of a language; bounds the automata (at most twice as many states)
SAMPLE_DOCS, LONG = 120, 8_000  # documents of a language to choose from; longer ones come last and are cut to this
PAD, SPACE, OTHER, FIRST = 0, 1, 2, 3  # codes; OTHER is a letter of no sample
WIDTH = 64  # columns of a transition row: PAD, SPACE, OTHER, the 60 most frequent letters of the language, and RARE for its further letters
RARE = WIDTH - 1  # their transitions are looked up in a sorted list
SEGMENT, LANES = 256, 8192  # a text is parsed in segments of this length, many segments at a time
MISS = 1 << 30


def training_sample(docs: DataFrame, max_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Language to sample text, languages with most rows first: whole documents in hash order until max_chars, learnt rows only.

    Rows of fold 0 and rows with a null id, language or text take no part. Bounded: at most SAMPLE_DOCS documents of
    LONG characters for each language reach the driver; the number of languages is that of the labels.
    """
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * SAMPLE_DOCS / n))])
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    some = rows.where(order < (share[F.col("lang")] * float(1 << 40)))
    some = some.select("lang", "doc_id", order.alias("order"), (F.length("text") > LONG).alias("long"), F.substring("text", 1, LONG).alias("text")).where(r"text rlike '\\p{L}'")
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("long", "order", "doc_id", "text"))).where(F.col("k") <= SAMPLE_DOCS)
    found: dict[str, str] = {}
    for r in some.select("lang", "k", "text").orderBy("lang", "k").collect():
        own = found.get(r["lang"], "")
        if len(own) < max_chars:
            found[r["lang"]] = (own + "\n" + r["text"])[:max_chars]
    return {k: found[k] for k in sorted(found, key=lambda k: (-counts[k], k))}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(codes: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links of the automaton of all substrings."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step, link


class Parser:
    """Automata of all languages as dense tables, with sorted lists for rare letters. An entry is the next row's start; MISS marks
    that the longest match ended and the entry starts a new phrase at the root. PAD stays where it is. Every letter of the samples
    has a code of its own; each language gives columns to its own most frequent letters."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [k for k, _ in samples]
        seen = Counter(c for _, t in samples for c in t.lower() if c.isalpha())
        self.code = np.where(_letters(), OTHER, SPACE).astype(np.int32)
        for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
            self.code[ord(c)] = FIRST + i
        self.size = FIRST + len(seen)
        self.columns, self.tables, self.rare, self.weights = [], [], [], []
        for _, text in samples:
            codes = self.codes(text)
            own = sorted(Counter(codes[codes >= FIRST].tolist()).items(), key=lambda x: (-x[1], x[0]))
            column = np.full(self.size, OTHER, np.int32)
            column[[PAD, SPACE]] = PAD, SPACE
            for i, (c, _) in enumerate(own):
                column[c] = min(FIRST + i, RARE)
            step, _ = suffix_automaton(codes.tolist())
            rows = np.repeat(np.arange(len(step)), [len(x) for x in step])
            letter = np.array([c for x in step for c in x], np.int64)
            to = np.array([s for x in step for s in x.values()], np.int64) * WIDTH
            rare = column[letter] == RARE
            root = np.full(WIDTH, MISS, np.int32)
            first = np.full(self.size, MISS, np.int32)  # where a new phrase begins, by letter
            for c, s in step[0].items():
                first[c] = MISS | s * WIDTH
                if column[c] != RARE:
                    root[column[c]] = first[c]
            tab = np.repeat(root[None, :], len(step), 0)
            tab[rows[~rare], column[letter[~rare]]] = to[~rare]
            tab[:, PAD] = np.arange(len(step)) * WIDTH
            key = rows[rare] * self.size + letter[rare]
            order = np.argsort(key)
            self.columns.append(column)
            self.tables.append(tab.ravel())
            self.rare.append((key[order], to[rare][order].astype(np.int32), first))
            self.weights.append(np.log2(len(codes) + 2))

    def _rare(self, k: int, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Entries of language k for rare letters."""
        keys, to, first = self.rare[k]
        want = (state // WIDTH).astype(np.int64) * self.size + letter
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, to[at], first[letter])

    def codes(self, text: str) -> np.ndarray:
        """Codes of a text: letters, and one SPACE for each run of anything else."""
        c = self.code[_points(text)]
        return c[~((c == SPACE) & (np.concatenate(([SPACE], c[:-1])) == SPACE))]

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases times log2 of the sample size, for each text and language; and whether the text has a letter."""
        owner, parts, has = [], [], np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            c = self.codes(t)
            has[i] = bool((c != SPACE).any())
            if has[i]:
                n = -(-len(c) // SEGMENT)
                parts.append(np.concatenate((c, np.zeros(n * SEGMENT - len(c), np.int32))).reshape(n, SEGMENT))
                owner.append(np.full(n, i))
        cost = np.zeros((len(texts), len(self.names)))
        if parts:
            lanes, owner = np.concatenate(parts), np.concatenate(owner)
            for at in range(0, len(lanes), LANES):
                block = np.ascontiguousarray(lanes[at:at + LANES].T)
                for k, tab in enumerate(self.tables):
                    state, phrases = np.zeros(block.shape[1], np.int32), np.zeros(block.shape[1], np.int32)
                    own = self.columns[k][block]
                    line, lane = np.nonzero(own == RARE)
                    ends = np.searchsorted(line, np.arange(len(block) + 1))
                    for i, row in enumerate(own):
                        at_rare = lane[ends[i]:ends[i + 1]]
                        found = self._rare(k, state[at_rare], block[i, at_rare]) if len(at_rare) else None
                        state += row
                        state = tab.take(state)
                        if found is not None:
                            state[at_rare] = found
                        phrases += state >> 30
                        state &= MISS - 1
                    np.add.at(cost[:, k], owner[at:at + LANES], (phrases + 1) * self.weights[k])
        return cost, has


@lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def identify(docs: DataFrame, samples: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs.

    The language with the fewest phrases (weighted by the log of its sample's size) wins; equal counts go to
    the language that samples has first. score is the runner-up's count over the sum of both, 1 if there is a single language. Null texts and
    texts without a letter are `und` with score 0, as is everything if there are no samples. Very long texts are
    parsed whole, in segments. Repeated rows and null ids give a row each; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    given = tuple(samples.items())

    @F.pandas_udf(StructType().add("lang_pred", "string").add("score", "double"))
    def run(part: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in part]
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if given:
            own = parser(given)
            cost, has = own.costs(texts)
            best = cost.argmin(1)
            low = np.sort(cost, 1)
            lang[has] = np.array(own.names, object)[best[has]]
            score[has] = low[has, 1] / (low[has, 0] + low[has, 1]) if len(own.names) > 1 else 1.0
        return pd.DataFrame({"lang_pred": lang, "score": score})

    made = docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("found"))
    return made.select("doc_id", "found.lang_pred", "found.score")
