"""Place columns."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import fixed as V
from .base import any_contains, any_of, col, let, quoted_alternation, squeeze, text


def _is_cjk(word: str) -> bool:
    return any("一" <= ch <= "鿿" for ch in word)


def _place_pattern(tokens) -> str:
    """One pattern for a token list: CJK anywhere, Latin words between word edges."""
    parts = []
    for t in tokens:
        if _is_cjk(t) or t.startswith(","):
            parts.append(quoted_alternation([t]))
        else:
            words = [w for w in re.split(r"[^a-z0-9]+", t) if w]
            parts.append(r"(?<![a-z0-9])" + r"[^a-z0-9]+".join(words) + r"(?![a-z0-9])")
    return "|".join(parts)


def city(c) -> Column:
    """Canonical city: exact alias first, else the first alias contained, else as given."""
    return _alias_lookup(c, V.CITY_ALIASES + V.NATIONWIDE_ALIASES + V.REMOTE_ALIASES)


def city_wide(c) -> Column:
    """Same with the overseas cities used for matching."""
    return _alias_lookup(c, V.CITY_ALIASES + V.OVERSEAS_CITY_ALIASES + V.NATIONWIDE_ALIASES
                         + list(reversed(V.REMOTE_ALIASES)))


def _alias_lookup(c, aliases) -> Column:
    key = F.lower(F.trim(text(c)))
    chain = F.when(key == "", col(c))
    exact = {}
    for alias, name in aliases:
        exact.setdefault(name, []).append(alias)
    for name, keys in exact.items():
        chain = chain.when(key.isin(keys), name)
    for alias, name in aliases:
        chain = chain.when(key.contains(alias), name)
    return chain.otherwise(col(c))


def clean_location(c) -> Column:
    named = lambda loc: F.when(F.lower(loc).isin(V.BLANK_LOCATIONS) | loc.isNull(), F.lit(None)).otherwise(city(loc))
    return let(squeeze(F.replace(col(c), F.lit("\x00"), F.lit(""))), named)


def city_tokens(name: str) -> list[str]:
    """All lower-case spellings that stand for a chosen city."""
    aliases = V.CITY_ALIASES + V.OVERSEAS_CITY_ALIASES + V.NATIONWIDE_ALIASES + V.REMOTE_ALIASES
    raw = (name or "").strip()
    if not raw:
        return []
    key = " ".join(raw.lower().split())
    canonical = dict(aliases).get(key) or next((n for a, n in aliases if a in key), raw)
    out = [key, canonical.lower()] + [a for a, n in aliases if n == canonical]
    return list(dict.fromkeys(t for t in out if t))


def normalize_location(c) -> Column:
    """Each part of a location list by its city name; foreign names stay as written."""
    raw = F.trim(text(c))
    overseas = sorted({n for _a, n in V.OVERSEAS_CITY_ALIASES})
    aliases = sorted({a for a, _n in V.CITY_ALIASES + V.NATIONWIDE_ALIASES + V.REMOTE_ALIASES})
    clean = F.filter(F.transform(F.split(raw, r"[,，、/|;；]+"), lambda x: F.trim(x)), lambda p: p != "")
    named = F.transform(clean, lambda p: F.when(city_wide(p).isin(overseas), p).otherwise(city_wide(p)))
    known = F.exists(clean, lambda p: ~city_wide(p).isin(overseas)
                     & (F.lower(p).isin(aliases) | (city_wide(p) != p)))
    return F.when(raw == "", F.lit(None)).when(known, F.array_join(F.array_distinct(named), "、")).otherwise(raw)


def country_code(c) -> Column:
    t = F.lower(F.trim(text(c)))
    hit = lambda tokens: t.rlike(_place_pattern(tokens))
    return (F.when((t == "") | t.isin("unknown", "multiple locations"), F.lit(None).cast("string"))
             .when(hit(V.TW_TOKENS), "TW").when(hit(V.HK_TOKENS), "HK").when(hit(V.MO_TOKENS), "MO")
             .when(hit(V.CHINA_LATIN + V.CHINA_CJK), "CN").when(hit(V.US_TOKENS), "US")
             .when(hit(V.SG_TOKENS), "SG"))


def job_scope(c) -> Column:
    code = country_code(c)
    return F.when(code.isNull() | code.isin(V.GREATER_CHINA), "domestic").otherwise("overseas")


def is_china(c) -> Column:
    t = F.lower(text(c))
    latin = quoted_alternation(V.CHINA_LATIN + ["hong kong", "macau", "macao"])
    word = r"[\p{L}\p{N}_]"
    pattern = f"(?<!{word})(?:{latin})(?!{word})"
    return (any_contains(t, V.CHINA_CJK + ["香港", "澳门"]) | t.rlike(pattern)
            | F.regexp_replace(t, r"[\s,\-/]+", " ").rlike(pattern))


def is_remote(c) -> Column:
    return any_contains(F.lower(text(c)), V.REMOTE_MARKERS)


def is_overseas(c) -> Column:
    t = F.lower(text(c))
    return (any_contains(t, V.OVERSEAS_PHRASES)
            | F.arrays_overlap(F.split(t, r"[^a-z]+"), F.array(*[F.lit(w) for w in V.OVERSEAS_WORDS])))


def keep_for_china(c) -> Column:
    return is_china(c) | (is_remote(c) & ~is_overseas(c))


def is_china_company_location(c) -> Column:
    t = F.trim(text(c))
    return ((t != "") & ~any_contains(t, V.COMPANY_API_FOREIGN)
            & (is_china(t) | t.contains("全国") | t.contains("多省") | any_contains(t, V.COMPANY_API_CITIES)
               | t.rlike("(?:" + "|".join(V.ADMIN_SUFFIXES) + ")$")))


def location_in_scope(c, regions) -> Column:
    """Whether a location falls in a source's regions (array column; default CN)."""
    want = F.coalesce(col(regions), F.array(F.lit("CN")))
    want = F.when(F.size(want) == 0, F.array(F.lit("CN"))).otherwise(want)
    code = country_code(c)
    cn = F.array_contains(want, "CN")
    return (F.when(code.isNotNull(), F.array_contains(want, code) | (cn & code.isin(V.GREATER_CHINA)))
             .when(is_remote(c), F.array_contains(want, "Remote") | cn)
             .otherwise(False))


def region(value: str | None) -> str:
    return V.REGION_ALIASES.get((value or "").strip().lower(), "") if isinstance(value, str) else ""


def effective_regions(scope: str | None, regions) -> list[str]:
    """Target regions of a preference record; overseas searches default to three."""
    if scope not in ("overseas", "all"):
        return []
    found = [r for r in dict.fromkeys(region(x) for x in regions or []) if r]
    return found or list(V.DEFAULT_OVERSEAS_REGIONS)


def matches_region(scope, country, location, wanted: str) -> Column:
    """Region test of one posting; an unknown region name passes everything."""
    r = region(wanted)
    if not r:
        return F.lit(True)
    overseas = text(scope) == "overseas"
    if r == "Remote":
        loc = F.lower(text(location))
        return overseas & (text(country) == "") & (loc.contains("remote") | loc.contains("远程"))
    return overseas & (F.upper(text(country)) == r)


def in_scope(scope, country, location, want_scope: str | None, regions=None, wanted_region: str | None = None) -> Column:
    """Scope predicate of a search: an explicit region wins over the preference scope."""
    if region(wanted_region):
        return matches_region(scope, country, location, wanted_region)
    if want_scope == "all":
        return F.lit(True)
    if want_scope == "overseas":
        return (text(scope) == "overseas") & any_of(
            matches_region(scope, country, location, r) for r in effective_regions("overseas", regions))
    return F.coalesce(col(scope), F.lit("domestic")) == "domestic"
