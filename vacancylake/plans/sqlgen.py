"""Helpers that spell a fixed rule list as SQL for the comparison statements."""
from ..functions import fixed as V


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws) -> str:
    return "(" + ", ".join(q(w) for w in ws) + ")"


def rules(subject: str, table, default: str = "null") -> str:
    return "case " + " ".join(f"when regexp_matches({subject}, {q('(?i)' + p)}) then {q(l)}" for l, p in table) + f" else {default} end"


def contains_any(subject: str, needles) -> str:
    return "(" + " or ".join(f"contains({subject}, {q(n)})" for n in needles) + ")"


def tokens_hit(subject: str, tokens) -> str:
    """CJK pieces anywhere, Latin words between non-alphanumeric edges."""
    import re
    out = []
    for t in tokens:
        if any("一" <= ch <= "鿿" for ch in t) or t.startswith(","):
            out.append(f"contains({subject}, {q(t)})")
        else:
            body = "[^a-z0-9]+".join(w for w in re.split(r"[^a-z0-9]+", t) if w)
            out.append(f"regexp_matches({subject}, {q('(^|[^a-z0-9])' + body + '([^a-z0-9]|$)')})")
    return "(" + " or ".join(out) + ")"


def country(c: str) -> str:
    t = f"lower(trim(coalesce({c}, '')))"
    return (f"case when {t} in ('', 'unknown', 'multiple locations') then null"
            + "".join(f" when {tokens_hit(t, toks)} then '{code}'" for code, toks in (
                ("TW", V.TW_TOKENS), ("HK", V.HK_TOKENS), ("MO", V.MO_TOKENS),
                ("CN", V.CHINA_LATIN + V.CHINA_CJK), ("US", V.US_TOKENS), ("SG", V.SG_TOKENS))) + " else null end")


def city(c: str, aliases=None) -> str:
    aliases = aliases or (V.CITY_ALIASES + V.NATIONWIDE_ALIASES + V.REMOTE_ALIASES)
    k = f"lower(trim(coalesce({c}, '')))"
    return (f"case when {k} = '' then {c}" + "".join(f" when {k} = {q(a)} then {q(n)}" for a, n in aliases)
            + "".join(f" when contains({k}, {q(a)}) then {q(n)}" for a, n in aliases) + f" else {c} end")


def min_years(raw: str) -> str:
    """Latin part of the required-years rule plus the plain CJK form."""
    t = f"regexp_replace({raw}, '\\s+', '', 'g')"
    return (f"coalesce(try_cast(nullif(regexp_extract({t}, '(\\d{{1,2}})[-~to]+\\d{{1,2}}years?', 1), '') as int),"
            f" try_cast(nullif(regexp_extract({t}, '(\\d{{1,2}})\\+?years?(?:ofexperience)?', 1), '') as int),"
            f" case when regexp_matches({raw}, '\\b(principal|distinguished)\\b') then 12 when regexp_matches({raw}, '\\b(staff|lead)\\b') then 8"
            f" when regexp_matches({raw}, '\\bsenior\\b') then 5 when regexp_matches({raw}, '\\b(mid[-\\s]?level|intermediate)\\b') then 3"
            f" when regexp_matches({raw}, '\\b(entry[-\\s]?level|junior)\\b') then 0 end)")


FOLD = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


def fold(c: str) -> str:
    return FOLD.replace("{c}", c)


def function_of(t: str) -> str:
    ns = f"(regexp_matches({t}, {q(V.NON_SOFTWARE_DOMAIN)}) and not regexp_matches({t}, {q('(?i)' + V.SOFTWARE_SIGNAL)}))"
    return "case " + " ".join(
        f"when regexp_matches({t}, {q('(?i)' + p)})" + (f" and not {ns}" if l == "研发" else "") + f" then {q(l)}"
        for l, p in V.JOB_FUNCTION_RULES) + " else '其他' end"


def declared(c: str) -> str:
    return (f"case when coalesce(trim({c}), '') = '' then null when regexp_matches({c}, {q('(?i)' + V.DECLARED_INTERN)}) then '实习'"
            f" when regexp_matches({c}, {q('(?i)' + V.DECLARED_SOCIAL)}) then '社招'"
            f" when regexp_matches({c}, {q('(?i)' + V.DECLARED_CAMPUS)}) then '校招' end")


def edu_rank(c: str) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '\\s+', '', 'g')"
    items = [(r, p) for _l, r, p in V.EDUCATION_LEVELS[:3]] + V.EDUCATION_RANK_EXTRA
    return "case " + " ".join(f"when regexp_matches({t}, {q('(?i)' + p)}) then {r}" for r, p in items) + " end"


def edu_clauses(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), '(?i)[，,、;；]|\\s+(?:and|or)\\s+|或'), lambda x: trim(x)), lambda x: x <> '')"


def edu_floor(c: str) -> str:
    return (f"list_min(list_filter(list_transform(list_filter({edu_clauses(c)}, lambda x: not regexp_matches(x, {q('(?i)' + V.EDUCATION_PREFERRED)})),"
            f" lambda x: {edu_rank('x')}), lambda r: r is not null))")


def monthly(c: str) -> str:
    """(lo, hi) in thousands as a struct, null when ambiguous."""
    s = f"lower(regexp_replace(coalesce({c}, ''), '\\s+', '', 'g'))"
    sp = "'(\\d+(?:\\.\\d+)?)(?:k|千)?[-~至到](\\d+(?:\\.\\d+)?)(?:k|千)'"
    fp = "'(\\d{4,6})[-~至到](\\d{4,6})'"
    one = lambda g: (f"case when regexp_extract({s}, {sp}, 1) <> '' then try_cast(regexp_extract({s}, {sp}, {g}) as double)"
                     f" else try_cast(nullif(regexp_extract({s}, {fp}, {g}), '') as double) / 1000 end")
    lo, hi = one(1), one(2)
    return f"(case when ({lo}) > 0 and ({hi}) >= ({lo}) and ({hi}) < 1000 then {{'lo': cast(floor(({lo}) + 0.5) as int), 'hi': cast(floor(({hi}) + 0.5) as int)}} end)"
