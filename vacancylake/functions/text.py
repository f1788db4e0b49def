"""Text columns: cleaning, hashing, recruitment type, experience, education, pay."""
from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from . import fixed as V
from .base import (BLANKS, any_contains, any_of, ascii_edges, col, extract, extract_all, find, first_rule, let, js_round,
                   quoted_alternation, squeeze, strip_spaces, text, unicode_edges)


def strip_nul(c) -> Column:
    return F.replace(col(c), F.lit("\x00"), F.lit(""))


def clean_title(c) -> Column:
    """Collapse blanks, drop a spaced-dash suffix ("Title - City")."""
    return F.trim(F.regexp_replace(squeeze(strip_nul(c)), r"\s+[-–—]\s+.*$", ""))


#: Named entities come from the standard library's table; a no-break space becomes a blank.
ENTITIES = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&nbsp;": " ", "&apos;": "'"}
ENTITY = r"&(?:#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]{1,8};)"


def _character(entity: Column) -> Column:
    """The character an entity stands for; the entity itself if it is unknown."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    digits = F.regexp_extract(entity, r"^&#([0-9]+);$", 1)
    hexes = F.when(digits != "", F.hex(digits.try_cast("bigint"))).otherwise(F.regexp_extract(entity, r"^&#[xX]([0-9a-fA-F]+);$", 1))
    code = F.conv(hexes, 16, 10).try_cast("bigint")
    real = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.when(real, F.when(code == 160, " ").otherwise(F.decode(F.unhex(F.lpad(hexes, 8, "0")), "UTF-32")))
    return F.coalesce(F.when(hexes != "", char), F.try_element_at(named, entity), entity)


def _unescape_once(c: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)))
    amp = lambda e: _character(e) == "&"
    # ampersands last: what they uncover belongs to the next round
    ordered = F.concat(F.filter(found, lambda e: ~amp(e)), F.filter(found, amp))
    return F.when(c.contains("&"), F.aggregate(ordered, c, lambda s, e: F.replace(s, e, _character(e)))).otherwise(c)


def unescape_html(c) -> Column:
    """Named and numeric entities, resolved twice because payloads are often double-escaped."""
    return let(let(col(c), _unescape_once), _unescape_once)


def strip_tags(c) -> Column:
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"(?is)<(script|style).*?</\1>", " "), r"<[^>]+>", " ")
    return squeeze(let(col(c), lambda s: F.when(s.contains("<"), bare(s)).otherwise(s)))


def shorten(c, max_chars: int) -> Column:
    """Cut at a word edge and marked with an ellipsis if it is longer."""
    s = col(c)
    head = F.substring(s, 1, max_chars)
    # position of the last blank inside the head
    last = F.length(head) - F.length(F.substring_index(head, " ", -1))
    cut = F.when(last - 1 > F.lit(max_chars * 0.8), F.substring(head, F.lit(1), last - 1)).otherwise(head)
    return F.when(F.length(s) <= max_chars, s).otherwise(F.concat(F.trim(cut), F.lit("…")))


def clean_summary(c, max_chars: int | None = None) -> Column:
    """Readable text, whole unless ``max_chars`` is given."""
    s = strip_tags(unescape_html(F.trim(strip_nul(c))))
    return F.when(text(c) == "", F.lit(None)).otherwise(s if max_chars is None else shorten(s, max_chars))


def clean_salary(c) -> Column:
    return F.when(text(c) == "", F.lit(None)).otherwise(F.trim(strip_nul(c)))


def content_hash(title, location, summary) -> Column:
    return F.sha2(F.concat_ws("|", text(title), text(location), text(summary)), 256)


def lower_joined(*cs) -> Column:
    """Texts in lower case, joined by blanks, nulls left out. Each is folded by itself: beside a title in other letters a plain text would be folded the slow way."""
    return F.concat_ws(" ", *[F.lower(col(c)) for c in cs])


def title_and_summary(title, summary) -> Column:
    return lower_joined(text(title), text(summary))


def job_type(title, summary) -> Column:
    return first_rule(title_and_summary(title, summary), V.JOB_TYPE_RULES, edges=unicode_edges)


def is_recruitment_type(c) -> Column:
    return any_contains(F.lower(F.trim(text(c))), V.RECRUIT_TYPE_WORDS)


def normalize_job_type(title, source_type=None, url=None, summary=None) -> Column:
    parts = [F.nullif(text(c), F.lit("")) for c in (title, source_type, url, summary) if c is not None]
    return first_rule(squeeze(lower_joined(*parts)), V.JOB_TYPE_FIELD_RULES)


def plain(c) -> Column:
    """Tags removed, blanks collapsed; null becomes empty."""
    return squeeze(let(text(c), lambda s: F.when(s.contains("<"), F.regexp_replace(s, r"<[^>]+>", " ")).otherwise(s)))


def experience_text(c) -> Column:
    def years(t, pattern, second=None):
        lo = F.regexp_extract(t, pattern, 1)
        if second is None:
            return F.when(lo != "", F.concat(lo, F.lit("年+")))
        return F.when(lo != "", F.concat(lo, F.lit("-"), F.regexp_extract(t, pattern, second), F.lit("年")))

    def by_number(t):
        return (F.when(any_contains(t, ["应届", "无经验要求", "经验不限", "不限经验", "no experience", "entry level", "entrylevel"]), "应届/不限")
                 .otherwise(F.coalesce(
                     F.when(t.contains("年"), F.coalesce(years(t, r"(\d+)[-~至到](\d+)年", 2),
                                                        years(t, r"(\d+)年(?:以上)?(?:工作)?经验"))),
                     F.when(t.rlike(r"(?i)[0-9]\+?year"), F.coalesce(
                         years(t, r"(?i)(\d+)[-~to]+(\d+)years?", 2),
                         years(t, r"(?i)(\d+)\+?years?(?:ofexperience)?"))))))

    def read(base):
        def by_level(b):
            level = lambda *ws: find(b, "|".join(rf"\b{w}\b" for w in ws), unicode_edges)
            return F.coalesce(
                F.when(level("principal", "distinguished"), "12年+"),
                F.when(level("staff", "lead"), "8年+"),
                F.when(level("senior"), "5年+"),
                F.when(level(r"mid[-\s]?level", "intermediate"), "3年+"),
                F.when(level("junior"), "应届/不限"))
        # numbers and words are sought in one lower-cased text
        return F.when(base != "", let(F.lower(base), lambda low: F.coalesce(let(strip_spaces(low), by_number), by_level(low))))

    return let(plain(c), read)


CONTEXT = "(?:经验|经历|从业)"
YEARS = r"(\d{1,2})(?:[-~至到]\d{1,2})?年(?!级)"
# "N年" with an experience word within 25 characters on either side
# what is looked for comes first, so that few places look back for a word
YEARS_NEAR = f"(?={YEARS.replace('(', '(?:', 1)})(?:(?<={CONTEXT}.{{0,23}}){YEARS}|{YEARS}(?:以上)?(?=.{{0,23}}{CONTEXT}))"


def min_years(*parts) -> Column:
    """Lowest number of years a posting asks for, or a floor implied by its level word."""
    def by_number(t):
        near = F.regexp_extract(t, "(?:" + YEARS_NEAR + ")", 0)
        return F.coalesce(
            F.when(t.contains("年"), extract(near, r"^(\d{1,2})").cast("int")),
            F.when(t.contains("year"), F.coalesce(
                extract(t, r"(\d{1,2})[-~to]+\d{1,2}years?").cast("int"),
                extract(t, r"(\d{1,2})\+?years?(?:ofexperience)?").cast("int"))))

    def read(raw):
        level = lambda p: find(raw, p)
        return F.coalesce(
            F.when(raw.rlike("[0-9]"), let(strip_spaces(raw), by_number)),
            F.when(level(r"\bprincipal\b|\bdistinguished\b"), F.lit(12)),
            F.when(level(r"\bstaff\b|\blead\b"), F.lit(8)),
            F.when(level(r"\bsenior\b"), F.lit(5)),
            F.when(level(r"\bmid[-\s]?level\b|\bintermediate\b"), F.lit(3)),
            F.when(level(r"\bentry[-\s]?level\b|\bjunior\b"), F.lit(0)))

    return let(lower_joined(*[F.nullif(text(c), F.lit("")) for c in parts]), read)


def education_level(c) -> Column:
    def read(base):
        def level(t):
            chain = F.when(base == "", F.lit(None))
            for label, _rank, pattern in V.EDUCATION_LEVELS:
                chain = chain.when(find(t, pattern), label)
            return chain.when(any_contains(base, ["学历不限", "不限学历"]), "不限")
        return let(F.lower(strip_spaces(base)), level)
    return let(plain(c), read)


def education_rank(c) -> Column:
    """0 (no requirement) to 6 (doctorate), null when the text names no level."""
    def rank_of(t):
        chain = F.when(t == "", F.lit(None).cast("int"))
        for _label, rank, pattern in V.EDUCATION_LEVELS[:3]:
            chain = chain.when(t.rlike(pattern), F.lit(rank))
        for rank, pattern in V.EDUCATION_RANK_EXTRA:
            chain = chain.when(t.rlike(pattern), F.lit(rank))
        return chain
    # most levels are short words without a blank in them
    return let(F.lower(text(c)), lambda t: F.when(t.rlike(f"[{BLANKS}]"), let(F.lower(strip_spaces(text(c))), rank_of)).otherwise(rank_of(t)))


def _education_clauses(c) -> Column:
    return F.filter(F.transform(F.split(text(c), r"(?i)[，,、;；]|\s+(?:and|or)\s+|或"), lambda x: F.trim(x)), lambda x: x != "")


def _ranked_clauses(c) -> Column:
    """Clauses that name a level: struct(rank, hard), hard unless the clause is a mere wish."""
    ranked = F.transform(_education_clauses(c), lambda x: F.struct(education_rank(x).alias("rank"), (~let(F.lower(x), lambda t: find(t, V.EDUCATION_PREFERRED))).alias("hard")))
    return F.filter(ranked, lambda r: r["rank"].isNotNull())


def _floor_of(ranked: Column) -> Column:
    return F.array_min(F.transform(F.filter(ranked, lambda r: r["hard"]), lambda r: r["rank"]))


def education_floor(c) -> Column:
    """Lowest rank among the clauses that are real requirements."""
    return _floor_of(_ranked_clauses(c))


def education_read(c) -> Column:
    """struct(floor, saw): the least degree a posting's requirement asks for, and whether it names any."""
    return let(_ranked_clauses(c), lambda r: F.struct(_floor_of(r).alias("floor"), (F.size(r) > 0).alias("saw")))


def education_match(c, want, read=None) -> Column:
    """pass / degrade / reject of a posting's requirement against a wanted level; ``read`` is its education_read, if taken before."""
    wanted = education_rank(want)
    judged = lambda r: (F.when(r["floor"].isNull(), F.when(r["saw"], "pass").otherwise("degrade"))
                        .when(wanted.isNotNull() & (r["floor"] > wanted), "reject").otherwise("pass"))
    read = let(education_read(c), judged) if read is None else judged(col(read))
    return F.when(text(want) == "", "pass").when(F.trim(text(c)) == "", "degrade").otherwise(read)


def sponsorship(*cs) -> Column:
    def signal(t):
        has = lambda ps: any_of(find(t, p, unicode_edges) for p in ps)
        return (F.when(has(V.SPONSOR_NONE), "none").when(has(V.SPONSOR_AVAILABLE), "available").otherwise("unknown"))
    return let(lower_joined(*cs), signal)


def salary_usd(c) -> Column:
    """A dollar range that stands next to a pay word."""
    t = unescape_html(F.regexp_replace(text(c), r"<[^>]+>", " "))
    pattern = "(?is)" + V.PAY_CONTEXT + r"[^\$]{0,90}?" + V.PAY_RANGE
    lo, lk, hi, hk = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3, 4))
    big = lambda n, k: (k != "") | (F.length(F.replace(n, F.lit(","), F.lit(""))) >= 4)
    fmt = lambda n, k: F.concat(F.lit("$"), n, F.when(k != "", "K").otherwise(""))
    return F.when((lo != "") & big(lo, lk) & big(hi, hk), F.concat(fmt(lo, lk), F.lit(" – "), fmt(hi, hk)))


def salary_from_comp(json_col) -> Column:
    """Formatted range of a structured compensation payload (JSON text)."""
    j = col(json_col)
    tier = F.get_json_object(j, "$.compensationTierSummary")
    comps = F.from_json(F.get_json_object(j, "$.summaryComponents"),
                        "array<struct<compensationType:string,label:string>>")
    part = F.try_element_at(F.filter(comps, lambda x: (x["compensationType"] == "Salary") & x["label"].contains("$")),
                            F.lit(1))["label"]
    return F.when(tier.contains("$"), F.trim(tier)).otherwise(F.trim(part))


def monthly_k(c) -> Column:
    """struct(min_k, max_k) of a monthly range in thousands; null when ambiguous."""
    s = F.lower(strip_spaces(text(c)))
    short = r"(\d+(?:\.\d+)?)(?:k|千)?[-~至到](\d+(?:\.\d+)?)(?:k|千)"
    full = r"(\d{4,6})[-~至到](\d{4,6})"
    short_hit = F.regexp_extract(s, short, 1) != ""
    num = lambda p, g: F.regexp_extract(s, p, g).try_cast("double")
    lo = F.when(short_hit, num(short, 1)).otherwise(num(full, 1) / 1000)
    hi = F.when(short_hit, num(short, 2)).otherwise(num(full, 2) / 1000)
    ok = (lo > 0) & (hi >= lo) & (hi < 1000)
    return F.when(ok, F.struct(js_round(lo).cast("int").alias("min_k"), js_round(hi).cast("int").alias("max_k")))


def recruit_bucket(job_type_col, title) -> Column:
    t = F.lower(F.concat(text(job_type_col), F.lit(" "), text(title)))
    return first_rule(t, V.RECRUIT_BUCKET_RULES, "unknown")


def coarse_function(title) -> Column:
    return F.when(text(title) == "", F.lit(None)).otherwise(first_rule(title, V.COARSE_FUNCTION_RULES, "其他"))


def city_head(location) -> Column:
    parts = F.filter(F.split(text(location), r"[·、,，/\s-]+"), lambda x: x != "")
    head = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    return F.nullif(F.trim(F.regexp_replace(head, "(市|地区)$", "")), F.lit(""))


def _function_of(t: Column) -> Column:
    not_software = find(t, V.NON_SOFTWARE_DOMAIN) & ~find(t, V.SOFTWARE_SIGNAL)
    chain = None
    for label, pattern in V.JOB_FUNCTION_RULES:
        hit = find(t, pattern)
        if label == "研发":
            hit = hit & ~not_software
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise("其他")


def fold(c) -> Column:
    """Lower case, blanks collapsed: the form terms are compared in."""
    return squeeze(F.lower(text(c)))


def job_function(title, summary) -> Column:
    """Function by the title; a title that tells nothing, or staff work, is read with the summary."""
    both = fold(F.concat_ws(" ", F.nullif(text(title), F.lit("")), F.nullif(text(summary), F.lit(""))))
    def of(by_title):
        wide = let(let(both, _function_of), lambda w: F.when(w != "其他", w).otherwise(by_title))
        return F.when(~by_title.isin("其他", "职能"), by_title).otherwise(wide)
    return let(let(fold(title), _function_of), of)


def declared_category(c) -> Column:
    return let(F.lower(F.trim(text(c))), lambda t: (
        F.when(t == "", F.lit(None)).when(find(t, V.DECLARED_INTERN), "实习")
         .when(find(t, V.DECLARED_SOCIAL), "社招").when(find(t, V.DECLARED_CAMPUS), "校招")))


def asks_experience(title, experience, summary) -> Column:
    return F.coalesce(min_years(title, experience, summary) >= 2, F.lit(False))


def _has(pattern, *cs) -> Column:
    return let(lower_joined(*[text(c) for c in cs]), lambda t: find(t, pattern))


def recruitment_category(title, job_type_col, summary, url, company, experience=None, senior=None) -> Column:
    """Intern / campus / social by layered evidence; the default is social.

    ``senior`` takes a precomputed ``asks_experience`` column.
    """
    senior = asks_experience(title, experience, summary) if senior is None else senior
    declared, link = declared_category(job_type_col), F.lower(text(url))
    return (F.when((declared == "实习") | _has(V.INTERN_SIGNAL, title) | link.rlike(r"/(?:shixi|intern)(?:/|\?|$)"), "实习")
             .when(senior, "社招")
             .when(declared.isNotNull(), declared)
             .when(link.rlike(r"/(?:xiaozhao|campus)(?:[-_][a-z]+)?(?:/|\?|$)"), "校招")
             .when(link.rlike(r"/(?:social|experienced)(?:[-_][a-z]+)?(?:/|\?|$)"), "社招")
             .when(_has(V.CAMPUS_SIGNAL, title, summary), "校招")
             .when(text(company).contains("实习"), "实习")
             .when(text(company).rlike("校招|校园招聘"), "校招")
             .otherwise("社招"))


def has_explicit_type(title, job_type_col, summary, url, company, experience=None, senior=None) -> Column:
    senior = asks_experience(title, experience, summary) if senior is None else senior
    return ((text(job_type_col) != "")
            | F.lower(text(url)).rlike(r"/(?:shixi|intern|xiaozhao|campus|social|experienced)(?:/|\?|$)")
            | _has(V.INTERN_SIGNAL, title) | _has(V.CAMPUS_SIGNAL, title, summary)
            | text(company).rlike("实习|校招|校园招聘") | senior)


#: words of which a text holds one where the pattern of the same place in V.GRAD_CLASS_PATTERNS matches
GRAD_CLASS_WORDS = [["届"], ["届"], ["招"], ["应届"], ["实习生"], ["class"], ["graduate", "campus"]]


def grad_class(title, job_type_col, summary) -> Column:
    """Latest graduation year named with a class word, null without one."""
    parts = [F.nullif(text(c), F.lit("")) for c in (title, job_type_col, summary)]
    t = F.concat_ws(" ", *parts)
    lo, hi = V.GRAD_CLASS_RANGE

    def read(x):
        s, low, none = x["t"], x["low"], F.array().cast("array<string>")
        # without one of its words a pattern cannot match; only the others are sought
        found = F.concat(*[F.when(any_contains(low if p.startswith("(?i)") else s, words), extract_all(s, p)).otherwise(none) for p, words in zip(V.GRAD_CLASS_PATTERNS, GRAD_CLASS_WORDS, strict=True)])
        years = F.transform(F.transform(found, lambda y: y.cast("int")), lambda y: F.when(y < 100, y + 2000).otherwise(y))
        return F.when(s.rlike("[0-9]"), F.array_max(F.filter(years, lambda y: (y >= lo) & (y <= hi))))
    return let(F.struct(t.alias("t"), lower_joined(*parts).alias("low")), read)


def is_valid_active(status, summary) -> Column:
    return (col(status) == "active") & (F.length(F.trim(col(summary))) >= V.MIN_SUMMARY_CHARS)


def split_multi(c) -> Column:
    """Values separated by blanks or commas, in order, without repeats."""
    return F.array_distinct(F.filter(F.split(text(c), r"[\s,，　]+"), lambda x: x != ""))


def display_key(c) -> Column:
    return F.lower(F.trim(col(c)))
