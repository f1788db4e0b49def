"""Keyword matching in two tiers, as set algebra over precomputed features.

A posting is read once: which vocabulary groups its title, its body and its whole
text name, and what function it belongs to. A query is read once: its groups, its
literal words, its functions. A (query, posting) pair then only compares small
arrays, however many queries there are.
"""
from __future__ import annotations

import re
from typing import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import fixed as V
from .base import any_of, ascii_edges, bound, col, find, first_rule, let, quoted_alternation, text
from .text import fold, job_function
from .tokens import query_tokens

Groups = Sequence[tuple]


def is_short(term: str) -> bool:
    return len(term) <= 3 and all(ch in "abcdefghijklmnopqrstuvwxyz0123456789.+#-" for ch in term)


def contains_term(haystack: Column, term: str) -> Column:
    """Short Latin terms need word edges, others may stand anywhere."""
    t = " ".join(term.lower().split())
    if is_short(t):
        return haystack.contains(t) & haystack.rlike("(?:^|[^a-z0-9])" + quoted_alternation([t]) + "(?:[^a-z0-9]|$)")
    return haystack.contains(t)


def contains_literal(haystack: Column, term: Column) -> Column:
    """Same for a term held in a column."""
    quoted = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), term, F.lit(r"\E([^a-z0-9]|$)"))
    return F.when(term.rlike(r"^[a-z0-9.+#-]{1,3}$"), haystack.contains(term) & F.regexp_like(haystack, quoted)).otherwise(haystack.contains(term))


def _groups_in(subject: Column, groups: Groups, skip: Sequence[str] = ()) -> Column:
    """Indexes of the groups any of whose terms the text holds."""
    flags = []
    for i, (_fn, terms) in enumerate(groups):
        use = [t for t in terms if t not in skip]
        hit = any_of(contains_term(subject, t) for t in use)
        flags.append(F.when(hit, F.lit(i)) if use else F.lit(None).cast("int"))
    return F.array_compact(F.array(*flags))


def vocabulary(groups: Groups | None = None, overseas: bool = False) -> list[tuple]:
    """Base groups followed, for overseas searches, by the English role wording."""
    base = list(groups or V.KEYWORD_GROUPS)
    return base + [(None, g) for g in V.OVERSEAS_LEXICON] if overseas else base


HITS = "struct<title_groups:array<int>,body_groups:array<int>,all_groups:array<int>>"
_SCANNERS: dict = {}
RUN = re.compile("[a-z0-9]+")


def _scanner(terms: tuple):
    """Multi-pattern automaton of (term, group, short, anchor) and the uses of short plain words, built once per worker.

    A short term of letters and digits alone is found when it is a whole run of them, so those are looked up run by run.
    """
    if terms not in _SCANNERS:
        import ahocorasick
        by_term: dict = {}
        for term, group, short, anchor in terms:
            by_term.setdefault(term, []).append((group, short, anchor, len(term)))
        machine, words = ahocorasick.Automaton(), {}
        for term, uses in by_term.items():
            if uses[0][1] and RUN.fullmatch(term):
                words[term] = uses
            else:
                machine.add_word(term, uses)
        machine.make_automaton()
        _SCANNERS[terms] = machine, words
    return _SCANNERS[terms]


def _group_scan(groups: Groups):
    """Arrow function: one pass over a text finds every vocabulary term it holds.

    The text is read once instead of once per term: with 130 terms that is some fifty
    times less work than substring tests.
    """
    from pyspark.sql.types import StructType
    fold_term = lambda t: " ".join(t.lower().split())
    terms = tuple((fold_term(t), i, is_short(fold_term(t)), t in V.TITLE_ONLY_ANCHORS) for i, g in enumerate(groups) for t in g[1])
    schema = StructType.fromDDL(HITS[len("struct<"):-1].replace(":", " "))

    @F.pandas_udf(schema)
    def scan(title: pd.Series, body: pd.Series) -> pd.DataFrame:
        (machine, words), word = _scanner(terms), frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        rows = []
        for t, b in zip(title, body):
            whole = f"{t} {b}" if t and b else t or b
            cut, n = len(t), len(whole)
            in_title, in_body, anywhere = set(), set(), set()
            for run in words.keys() & RUN.findall(t):
                in_title.update(use[0] for use in words[run])
            for run in words.keys() & RUN.findall(b):
                anywhere.update(use[0] for use in words[run])
                in_body.update(use[0] for use in words[run] if not use[2])
            anywhere |= in_title
            for end, uses in (machine.iter(whole) if len(machine) else ()):
                for group, short, anchor, size in uses:
                    start = end - size + 1
                    if short and ((start > 0 and whole[start - 1] in word) or (end + 1 < n and whole[end + 1] in word)):
                        continue
                    anywhere.add(group)
                    if end < cut:
                        in_title.add(group)
                    elif start >= cut and not anchor:
                        in_body.add(group)
            rows.append((sorted(in_title), sorted(in_body), sorted(anywhere)))
        return pd.DataFrame(rows, columns=["title_groups", "body_groups", "all_groups"])

    return scan


def with_posting_features(jobs: DataFrame, groups: Groups) -> DataFrame:
    """Adds kw: struct(fn, title_groups, body_groups, all_groups, title, body) to postings."""
    part = lambda c: F.nullif(text(c), F.lit(""))
    body = fold(F.concat_ws(" ", part("company"), part("location"), part("job_type"), part("summary"), part("salary_text")))
    j = jobs.withColumn("_t", fold("title")).withColumn("_b", body)
    try:
        import ahocorasick  # noqa: F401
        j = j.withColumn("_g", _group_scan(groups)("_t", "_b"))
    except ImportError:
        every = F.concat_ws(" ", part("_t"), part("_b"))
        j = j.withColumn("_g", let(every, lambda a: F.struct(
            let(F.col("_t"), lambda t: _groups_in(t, groups)).alias("title_groups"),
            let(F.col("_b"), lambda b: _groups_in(b, groups, V.TITLE_ONLY_ANCHORS)).alias("body_groups"),
            _groups_in(a, groups).alias("all_groups"))))
    kw = F.struct(job_function("title", "summary").alias("fn"), F.col("_g.title_groups").alias("title_groups"), F.col("_g.body_groups").alias("body_groups"),
                  F.col("_g.all_groups").alias("all_groups"), F.col("_t").alias("title"), F.col("_b").alias("body"))
    return bound(j, "kw", kw).drop("_t", "_b", "_g")


def _targets(groups: Groups) -> dict[int, int]:
    """For each added wording group, the base group it shares a term with (fixed vocabularies only)."""
    out = {}
    base = [(i, g[1]) for i, g in enumerate(groups) if i < len(groups) - len(V.OVERSEAS_LEXICON)]
    for j in range(len(base), len(groups)):
        for i, terms in base:
            if any(a == b or (a in b and not is_short(a)) or (b in a and not is_short(b)) for a in groups[j][1] for b in terms):
                out[j] = i
                break
    return out


QUERY_TYPE = "struct<units:array<array<int>>,literals:array<string>,fns:array<string>,siblings:array<int>,terms:array<string>>"


def query_features(q, groups: Groups, overseas: bool = False) -> Column:
    """units (groups, all needed), literals not covered by them, functions, sibling groups, search terms."""
    n_base = len(groups) - (len(V.OVERSEAS_LEXICON) if overseas else 0)
    fns = F.array(*[F.lit(g[0]) for g in groups])
    terms = F.array(*[F.array(*[F.lit(" ".join(t.lower().split())) for t in g[1]]) for g in groups])
    targets = _targets(groups) if overseas else {}
    target = F.array(*[F.lit(targets.get(i, -1)) for i in range(len(groups))])

    def build(raw, hits):
        base_hits = F.filter(hits, lambda i: i < n_base)
        words = F.array_distinct(F.filter(F.transform(F.split(raw, r"[\s,，、/|;；]+"), lambda w: w), lambda w: w != ""))
        named = F.flatten(F.transform(hits, lambda i: F.get(terms, i)))
        units = F.transform(F.filter(hits, lambda i: (i < n_base) | ~F.array_contains(base_hits, F.get(target, i))),
                            lambda i: F.array_union(F.array(i), F.filter(hits, lambda j: F.get(target, j) == i)))
        q_fns = F.array_distinct(F.array_compact(F.transform(base_hits, lambda i: F.get(fns, i))))
        siblings = F.filter(F.sequence(F.lit(0), F.lit(n_base - 1)),
                            lambda i: F.array_contains(q_fns, F.get(fns, i)) & ~F.array_contains(base_hits, i))
        literals = F.filter(words, lambda w: ~F.exists(named, lambda t: t.contains(w) | w.contains(t)))
        search = F.array_distinct(F.filter(F.concat(F.array(raw), words, named), lambda t: F.length(t) >= 2))
        empty = F.array().cast("array<int>")
        return F.struct(units.alias("units"), literals.alias("literals"), q_fns.alias("fns"),
                        F.when(F.size(q_fns) > 0, siblings).otherwise(empty).alias("siblings"), search.alias("terms"))

    return let(fold(q), lambda raw: let(_groups_in(raw, groups), lambda hits: build(raw, hits)))


def request_features(spark, words: Sequence[str], groups: Groups, overseas: bool = False) -> list[Column]:
    """Query features of the words of one request as constants: the vocabulary is read once, not per posting."""
    read = spark.range(1).select(F.array(*[query_features(F.lit(w), groups, overseas) for w in words]).alias("q")).first()["q"]
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    return [F.struct(F.array(*[ints(u) for u in q["units"]]).cast("array<array<int>>").alias("units"), texts(q["literals"]).alias("literals"),
                     texts(q["fns"]).alias("fns"), ints(q["siblings"]).alias("siblings"), texts(q["terms"]).alias("terms")) for q in read]


def request_clauses(spark, terms: Column) -> Column:
    """``clauses_of`` of constant terms, as a constant."""
    read = spark.range(1).select(clauses_of(terms).alias("c")).first()["c"]
    return F.array(*[F.array(*[F.lit(x) for x in cl]).cast("array<string>") for cl in read]).cast("array<array<string>>")


def keyword_tier(q, kw) -> Column:
    """exact / related / null of a query against a posting, from their features."""
    q, kw = col(q), col(kw)
    fn_ok = (F.size(q["fns"]) == 0) | F.array_contains(q["fns"], kw["fn"])
    units = F.forall(q["units"], lambda u: F.arrays_overlap(u, kw["title_groups"]) | (fn_ok & F.arrays_overlap(u, kw["body_groups"])))
    literals = F.forall(q["literals"], lambda l: contains_literal(kw["title"], l)
                        | (fn_ok & ~l.isin(V.TITLE_ONLY_ANCHORS) & contains_literal(kw["body"], l)))
    related = F.array_contains(q["fns"], kw["fn"]) & ~F.arrays_overlap(q["siblings"], kw["all_groups"])
    return F.when(units & literals, "exact").when(related, "related")


def best_tier(queries, kw) -> Column:
    """struct(tier, pos): exact if any query is exact, else the first related one."""
    return let(F.transform(col(queries), lambda q: keyword_tier(q, kw)), lambda ts: F.struct(
        F.when(F.exists(ts, lambda t: t == "exact"), "exact").when(F.exists(ts, lambda t: t == "related"), "related").alias("tier"),
        F.when(F.array_contains(ts, "exact"), F.array_position(ts, F.lit("exact")))
         .otherwise(F.nullif(F.array_position(ts, F.lit("related")), F.lit(0))).cast("int").alias("pos")))


def clauses_of(terms) -> Column:
    """Token lists of search terms; a document matches a term when it holds all its tokens."""
    return F.array_distinct(F.filter(F.transform(col(terms), lambda t: F.array_sort(query_tokens(t))), lambda a: F.size(a) > 0))


def company_industry(companies: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Industry of each distinct company: named overrides (name, industry, pos) first, then wording."""
    from ..operators.core import assign_first
    c = companies.select("company").where("company is not null").distinct()
    rule = first_rule("company", V.INDUSTRY_RULES)
    if overrides is None:
        return c.withColumn("industry", rule)
    named = assign_first(c, "company", overrides.select(F.col("name"), F.col("industry").alias("_named"), "pos"), "name", "pos")
    return c.join(named.select("company", "_named"), "company", "left").select("company", F.coalesce("_named", rule).alias("industry"))


def user_industry(c) -> Column:
    return F.when(col(c).isin([k for k, _ in V.USER_INDUSTRY_RULES]), col(c)).otherwise(first_rule(c, V.USER_INDUSTRY_RULES))


def target_categories(industries) -> Column:
    return F.array_distinct(F.array_compact(F.transform(col(industries), user_industry)))


def industry_allowed(category, targets) -> Column:
    """Unknown industries pass; a known one must be wanted."""
    return (F.size(col(targets)) <= 0) | col(category).isNull() | F.array_contains(col(targets), col(category))


def source_industry_ok(company, category, targets, exempt) -> Column:
    """Industry gate of a source; companies the user names are exempt."""
    low = F.lower(text(company))
    named = F.exists(F.filter(F.transform(col(exempt), lambda e: F.lower(F.trim(e))), lambda e: e != ""), lambda e: low.contains(e))
    return F.coalesce(named, F.lit(False)) | industry_allowed(category, targets)


def capital_origin(company, adapter=None) -> Column:
    """Capital origin by name list, else foreign for foreign systems, else domestic."""
    c = F.lower(text(company))
    chain = F.when(c == "", "其它")
    for origin, names in V.COMPANY_ORIGINS.items():
        chain = chain.when(col(company).isin(names), origin)
    for origin, names in V.COMPANY_ORIGINS.items():
        for n in names:
            chain = chain.when(c.contains(n.lower()) | F.lit(n.lower()).contains(c), origin)
    by_name = chain.otherwise("其它")
    if adapter is None:
        return by_name
    return let(by_name, lambda o: F.when(o != "其它", o).when(text(adapter).isin(V.FOREIGN_ADAPTERS), "外企").otherwise("中国"))
