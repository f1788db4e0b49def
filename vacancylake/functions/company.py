"""Company name columns. Four normalisations stay apart on purpose."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from . import fixed as V
from .base import any_of, col, quoted_alternation, strip_spaces, text

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def fold_width(c) -> Column:
    """Full-width letters, digits and signs by their plain forms (native part of NFKC)."""
    return F.translate(text(c), FULL_WIDTH, HALF_WIDTH)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Full Unicode compatibility form; use on distinct names only."""
    return s.str.normalize("NFKC")


def _strip_suffixes(s: Column, suffixes) -> Column:
    """Remove trailing company words while at least one character stays."""
    return F.regexp_replace(s, "(?<=.)(?:" + quoted_alternation(suffixes) + ")+$", "")


def cover_key(c) -> Column:
    """For exact coverage checks: width, case, blanks and legal suffixes folded."""
    return _strip_suffixes(strip_spaces(F.lower(F.trim(fold_width(c)))), V.COVER_SUFFIXES)


def match_key(c) -> Column:
    """For alias matching: legal words and punctuation removed anywhere."""
    s = F.lower(F.trim(text(c)))
    for p in V.MATCH_STRIP:
        s = F.regexp_replace(s, p, "")
    return s


def target_key(c) -> Column:
    """For proposed company lists: bracketed parts and suffixes removed."""
    s = F.lower(F.trim(text(c)))
    s = strip_spaces(F.regexp_replace(s, "[（(][^（）()]*[）)]", ""))
    return _strip_suffixes(s, V.TARGET_SUFFIXES)


def industry_key(c) -> Column:
    return strip_spaces(F.lower(text(c)))


KEYS = {"cover": cover_key, "match": match_key, "target": target_key, "industry": industry_key,
        "display": lambda c: F.lower(F.trim(col(c)))}


def company_key(c, rule: str = "cover") -> Column:
    return KEYS[rule](c)


def long_enough(key) -> Column:
    """A key may match inside a longer name when it is CJK or at least five characters."""
    return col(key).rlike(r"[一-鿿]") | (F.length(col(key)) >= 5)


PLACE_RE = "^(?:" + "|".join(V.PLACE_PREFIXES) + ")?(?:" + "|".join(V.PLACE_PREFIX_SUFFIXES) + ")?$"


def name_matches(name, token) -> Column:
    """A token names a company when it starts the name or only a place stands before it."""
    n, t = F.trim(text(name)), F.trim(text(token))
    pos = F.instr(n, t)
    return ((t != "") & (pos > 0)
            & ((pos == 1) | F.substring(n, F.lit(1), pos - 1).rlike(PLACE_RE)))
