"""Secret scan: base patterns, and a battery of randomness tests with length-aware control of false discoveries."""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from vacancylake.llm.common import bounded_batches, stored

KINDS = ("assign", "access", "hex", "random")  # order of kinds at equal starts
#: Base patterns: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")  # '=' only as padding: in name=value the value is a run of its own
PART = re.compile(r"[A-Za-z0-9+_-]{20,}={0,2}(?![A-Za-z0-9+_-])")  # segment of a path
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Alphabets an encoding may use, narrowest first, each in its order.
ALPHABETS = (("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
             ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"))
RANKS = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS}
LENGTH_CLASSES = (20, 28, 40, 64)  # lower ends
SPREAD = (8, 12, 24, 40)  # lengths that decoys of a class take from its lower end on
WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]{5,19}(?![A-Za-z])")  # long enough to be parts of a compound
JOINTS, WORD_CHARS = ("", "_", "-", "/"), 4000  # between the words of a decoy; characters of a text that a pair of decoys is made from
Q, FLOOR, BINS = 0.05, 1e-3, 40  # allowed share of false discoveries; smallest p-value of a random text; bins of -log10(p) by 0.1
LEAST_REAL, LEAST_DECOYS = 20, 200  # classes with fewer candidates or decoys take their level from FIXED
#: (letters only, length class) to the p-value that one in a hundred decoys of the sf0.1 documents reaches, FLOOR at least. Almost all runs of
#: letters alone are words: their levels lie above one in a thousand decoys (0.70, 0.22, 0.016) and 14 long words tried by hand (0.36 and 0.32
#: at most in the first two classes), so short keys of letters alone are mostly missed in small tables.
FIXED = {(False, 0): 0.6, (False, 1): 0.065, (False, 2): 0.001, (False, 3): 0.001, (True, 0): 0.8, (True, 1): 0.5, (True, 2): 0.05, (True, 3): 0.001}

SPAN = ArrayType(StructType().add("start", "long").add("kind_no", "integer").add("end", "long"))
CANDIDATE = ArrayType(StructType().add("start", "long").add("end", "long").add("length_class", "integer").add("letters", "boolean").add("decoy", "boolean").add("p", "double"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted: leftmost non-overlapping matches of each pattern that are long enough."""
    low, found = text.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]  # runs are maximal, so this equals HEX by length
    return sorted(found)


def _upper_tail(chi2: float, freedom: int) -> float:
    """Chance that a chi-squared variable exceeds chi2 (cube-root normal approximation)."""
    v = 2 / (9 * freedom)
    return 0.5 * math.erfc(((max(chi2, 0.0) / freedom) ** (1 / 3) - 1 + v) / math.sqrt(2 * v))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer_encoding(token: str) -> str | None:
    """The narrowest alphabet that has all characters of the token, padding aside."""
    chars = set(token.rstrip("="))
    return next((name for name, _ in ALPHABETS if chars <= RANKS[name].keys()), None)


def battery(token: str) -> float:
    """p-value of 'uniformly random in its encoding': chi-squared, runs and serial-correlation tests, joined by Fisher's rule."""
    name = infer_encoding(token)
    body = token.rstrip("=")
    n = len(body)
    if name is None or n < 2:
        return 0.0
    rank, size = RANKS[name], len(RANKS[name])
    x = [rank[c] for c in body]
    chi2 = sum(v * v for v in Counter(x).values()) * size / n - n
    ps = [_upper_tail(chi2, size - 1)]
    high = [v >= size / 2 for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        ps.append(_two_sided((1 + sum(p != q for p, q in zip(high, high[1:])) - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    serial = sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / spread if spread else 1.0
    ps.append(_two_sided((serial + 1 / n) * math.sqrt(n)))
    return _upper_tail(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 2 * len(ps))


def _with_parts(run: str) -> list[tuple[int, str]]:
    """A run and its segments between slashes, with their places in it."""
    return [(0, run)] + ([(m.start(), m[0]) for m in PART.finditer(run)] if "/" in run else [])


def _length_class(token: str) -> int:
    return sum(len(token) >= k for k in LENGTH_CLASSES) - 1


def candidates(text: str) -> list[tuple[int, int, int, bool, bool, float]]:
    """(start, end, length class, letters only, False, p) of long runs of code characters, and of the long segments of runs with slashes.

    Candidates are runs of letters alone, and runs with letters and at least two digits or more than one change of case inside.
    """
    found = []
    for start, token in ((m.start() + x, t) for m in RUN.finditer(text) for x, t in _with_parts(m[0])):
        digits = sum(c.isdigit() for c in token)
        letters = sum(c.isalpha() for c in token)
        turns = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:]))
        mixed = letters and (digits >= 2 or turns >= 2)
        if mixed or letters == len(token):
            found.append((start, start + len(token), _length_class(token), not mixed, False, battery(token if mixed else token.lower())))
    return found


def decoys(text: str) -> list[tuple[int, int, int, bool, bool, float]]:
    """The same for runs that are surely words, two for each stretch of WORD_CHARS characters of the whole text: different words of five letters or
    more that begin in the stretch, written together as one long word and as a name with a joint and a number. Place, length and spelling follow
    from the stretch; on them the battery's false alarms are counted."""
    begun: dict[int, list[str]] = {0: []}
    for m in WORD.finditer(text):
        begun.setdefault(m.start() // WORD_CHARS, []).append(m[0].lower())
    return [d for i, words in begun.items() for d in _decoys(text[i * WORD_CHARS:(i + 1) * WORD_CHARS], list(dict.fromkeys(words)))]


def _decoys(stretch: str, words: list[str]) -> list[tuple[int, int, int, bool, bool, float]]:
    h = zlib.crc32(stretch.encode("utf-8", "surrogatepass"))
    k = h % len(LENGTH_CLASSES)
    length = LENGTH_CLASSES[k] + (h >> 2) % SPREAD[k]
    at = (h >> 8) % max(1, len(words))
    words = words[at:] + words[:at]
    if sum(map(len, words)) < length:
        return []
    number = str(10 + (h >> 12) % 9990)
    name = JOINTS[(h >> 4) % 4].join(w.capitalize() if (h >> 6) & 1 else w for w in words)[:length - len(number)] + number
    return [(0, 0, k, letters, True, battery(token)) for letters, token in ((True, "".join(words)[:length]), (False, name))]


@F.pandas_udf(StructType().add("base", SPAN).add("found", CANDIDATE))
def _scan(texts: pd.Series) -> pd.DataFrame:
    base, found = [], []
    for t in texts:
        t = t or ""
        base.append([dict(zip(("start", "kind_no", "end"), x)) for x in base_spans(t)])
        found.append([dict(zip(("start", "end", "length_class", "letters", "decoy", "p"), x)) for x in candidates(t) + decoys(t)])
    return pd.DataFrame({"base": base, "found": found})


def cut_points(scanned: DataFrame, q: float = Q) -> dict[tuple[bool, int], float]:
    """Smallest p-value at which a candidate counts as random, for candidates (of letters only or not, length class), from counts over
    the whole corpus.

    Decoys estimate the false discoveries: at each level, the share of decoys above, times all candidates, must not exceed q times
    the candidates above. Classes with few candidates or few decoys take the level of FIXED. Only a histogram of fixed size (classes x bins
    x 2) reaches the driver. A large class that never gets there has none.
    """
    each = scanned.select(F.explode("found").alias("c")).select("c.*")
    level = F.least(F.floor(F.least(-10 * F.log10(F.greatest("p", F.lit(1e-12))), F.lit(1000.0))), F.lit(BINS)).cast("int")
    bins = each.groupBy("letters", "length_class", "decoy", level.alias("bin")).agg(F.count("*").alias("n")).collect()
    return levels({(r["letters"], r["length_class"], r["decoy"], r["bin"]): r["n"] for r in bins}, q)


def levels(have: dict[tuple[bool, int, bool, int], int], q: float = Q) -> dict[tuple[bool, int], float]:
    """cut_points of a histogram: (letters only, length class, decoy, bin) to count."""
    cuts = {}
    for letters, k in FIXED:
        total = {d: sum(have.get((letters, k, d, b), 0) for b in range(BINS + 1)) for d in (False, True)}
        if total[False] < LEAST_REAL or total[True] < LEAST_DECOYS:
            cuts[letters, k] = FIXED[letters, k]
            continue
        false = real = 0
        for b in range(BINS):
            false += have.get((letters, k, True, b), 0)
            real += have.get((letters, k, False, b), 0)
            at = 10 ** (-(b + 1) / 10)
            if real and at >= FLOOR and (false + 1) / (total[True] + 1) * total[False] / real <= q:
                cuts[letters, k] = at
    return cuts


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), q: float = Q) -> DataFrame:
    """The columns `keep` plus `spans`: array of (start, kind_no, end) sorted by start and kind, code points, end exclusive.

    Spans of the base patterns always stay; random-looking runs that overlap none of them are added where their length
    class allows it, a segment of a path only if its whole run is not. Null texts count as empty and have no span. Very long texts are scanned whole. Repeated rows give
    a row each; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    scanned = stored(docs.select(*keep, _scan(F.col(text)).alias("scan_result")).select(*keep, "scan_result.base", "scan_result.found"), "scanned")
    return with_spans(scanned, cut_points(scanned, q)).select(*keep, "spans")


def with_spans(scanned: DataFrame, cuts: dict[tuple[bool, int], float]) -> DataFrame:
    passed = lambda c: F.coalesce(*[F.when((c["letters"] == a) & (c["length_class"] == k) & (c["p"] >= p), True) for (a, k), p in cuts.items()], F.lit(False))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    more = F.transform(F.filter("found", lambda c: ~c["decoy"] & passed(c) & free(c)), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind_no"), c["end"].alias("end")))
    inside = lambda c: F.exists("more", lambda w: (w["start"] <= c["start"]) & (c["end"] <= w["end"]) & (w["end"] - w["start"] > c["end"] - c["start"]))
    return scanned.withColumn("more", more).withColumn("spans", F.array_sort(F.concat("base", F.filter("more", lambda c: ~inside(c))))).drop("more")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", q: float = Q) -> DataFrame:
    """docs with every span of the text replaced by `mark`; overlapping spans become one. Other columns are unchanged.

    Texts without a span, null texts included, stay as they are. Texts are scanned twice, once to count and once to cut.
    """
    bounded_batches(docs.sparkSession)
    cuts = cut_points(stored(docs.select(_scan(F.col(text)).alias("r")).select("r.found"), "scanned"), q)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is not None:
                base = base_spans(t)
                more = [(s, 3, e) for s, e, k, a, _, p in candidates(t) if p >= cuts.get((a, k), 2.0)]
                for s, e in reversed(_merged(base + more)):
                    t = t[:s] + mark + t[e:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.select(*[cut(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, _, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
