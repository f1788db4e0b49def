"""Small building blocks shared by the column functions."""
from __future__ import annotations

import re
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\s 　]+"


_ASCII_WORD, _ANY_WORD = "[A-Za-z0-9_]", r"[\p{L}\p{N}_]"


def _edges(pattern: str, word: str) -> str:
    # in front of a letter or a group the edge opens a word, everywhere else it closes one
    pattern = re.sub(r"\\b(?=[A-Za-z(])", lambda _m: f"(?<!{word})", pattern)
    return pattern.replace(r"\b", f"(?!{word})")


def ascii_edges(pattern: str) -> str:
    r"""Give \b the ASCII meaning: a CJK character next to a Latin word is an edge."""
    return _edges(pattern, _ASCII_WORD)


def unicode_edges(pattern: str) -> str:
    r"""Give \b the Unicode meaning: a CJK character counts as part of the word."""
    return _edges(pattern, _ANY_WORD)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c) -> Column:
    """The column, null read as the empty string; no column is the empty string."""
    if c is None:
        return F.lit("")
    return F.coalesce(col(c).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column computed once per row: a filter on it reads it and is not pushed below it, where it would repeat it."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def any_of(conds: Iterable[Column]) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds: Iterable[Column]) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def any_contains(c, needles: Sequence[str]) -> Column:
    return any_of(col(c).contains(n) for n in needles)


def quoted_alternation(words: Sequence[str]) -> str:
    return "|".join(re.sub(r"([\\.\[\]{}()*+?^$|#-])", r"\\\1", w) for w in words)


def _alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return out + [pattern[start:]]


def _spread(alternative: str) -> list[str]:
    r"""\b(?:a|b)\b as \ba\b and \bb\b, so that each has a piece of plain text of its own; anything else as it is."""
    whole = re.fullmatch(r"((?:\\b)?)\(\?:([^()]*)\)((?:\\b)?)", alternative)
    parts = _alternatives(whole[2]) if whole else []
    # an edge opens a word only in front of a letter (_edges)
    return [f"{whole[1]}{a}{whole[3]}" for a in parts] if parts and all(re.match("[A-Za-z]", a) for a in parts) else [alternative]


def _required_literal(alternative: str) -> str:
    """A piece of plain text every match of the alternative holds ('' if unknown)."""
    flat = re.sub(r"\\b", "", alternative)
    flat = re.sub(r"\[[^\]]*\][?*+]?(?:\{[^}]*\})?", "\0", flat)
    while re.search(r"\([^()]*\)", flat):
        flat = re.sub(r"\([^()]*\)[?*+]?", "\0", flat)
    flat = re.sub(r"\\[a-zA-Z][?*+]?(?:\{[^}]*\})?", "\0", flat)
    flat = re.sub(r"\\.[?*]", "\0", flat)
    flat = re.sub(r"\\(.)", r"\1", flat)
    flat = re.sub(r".[?*]|.\{[^}]*\}|[.+^$]", "\0", flat)
    return max(flat.split("\0"), key=len)


def find(c, pattern: str, edges=ascii_edges) -> Column:
    """Whether a pattern (written in lower case) occurs in lower-case text.

    Plain alternatives become substring tests. The others run as a regular expression
    only where a piece of text they need is present, which spares most rows the
    expensive scan.
    """
    subject = col(c)
    plain, guarded = [], []
    for alt in (a for group in _alternatives(pattern) for a in _spread(group)):
        if re.fullmatch(r"[\w\s/'-]+", alt):
            plain.append(subject.contains(alt))
        else:
            need = _required_literal(alt)
            test = subject.rlike(edges(alt))
            guarded.append(subject.contains(need) & test if need else test)
    return any_of(plain + guarded)


def first_rule(c, rules: Sequence[tuple], default=None, edges=ascii_edges) -> Column:
    """Label of the first rule whose pattern is found in the lower-cased text."""
    def chain(subject):
        out = None
        for label, pattern in rules:
            hit = find(subject, pattern, edges)
            out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
        return out.otherwise(F.lit(default))
    return let(F.lower(col(c)), chain)


def extract_all(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def extract(c, pattern: str, group: int = 1) -> Column:
    """Captured group, null when the pattern is not found."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def js_round(c) -> Column:
    """Round half towards positive infinity."""
    return F.floor(col(c) + F.lit(0.5))


BLANKS = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


ASCII_BLANKS = "\t\n\x0b\x0c\r"
#: Bytes that a blank beyond ASCII holds; a text without any of them needs no look at its characters.
WIDE_BLANK_BYTES = [b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf"]


def _blanks_as(c, to: str) -> Column:
    """Blanks of any kind replaced, by byte search where the text allows it."""
    def one(s, b):
        return let(s, lambda x: F.when(x.contains(b), F.replace(x, F.lit(b), F.lit(to))).otherwise(x))
    def narrow(s):
        for b in (ASCII_BLANKS if to else " " + ASCII_BLANKS):
            s = one(s, b)
        return s
    wide = lambda s: (F.length(s) < F.octet_length(s)) & any_of(F.contains(s.cast("binary"), F.lit(b)) for b in WIDE_BLANK_BYTES)
    return let(col(c), lambda s: F.when(wide(s), F.translate(s, BLANKS, to * len(BLANKS))).otherwise(narrow(s)))


def squeeze(c) -> Column:
    """Blanks of any kind collapsed to one space; texts without runs of blanks skip the regular expression."""
    return let(_blanks_as(c, " "), lambda s: F.trim(F.when(s.contains("  "), F.regexp_replace(s, " {2,}", " ")).otherwise(s)))


def strip_spaces(c) -> Column:
    return _blanks_as(c, "")


def hours_between(later, earlier) -> Column:
    return (F.unix_micros(ts(later)) - F.unix_micros(ts(earlier))) / F.lit(3_600_000_000.0)


def ts(c) -> Column:
    return col(c).cast("timestamp")


def at(now) -> Column:
    """A fixed point in time: every job takes it as a parameter."""
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp")


def shanghai_date(c) -> Column:
    return F.to_date(F.from_utc_timestamp(ts(c), "Asia/Shanghai"))
