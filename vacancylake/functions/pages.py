"""Links and fetched pages: source class of a link, platform and state of a page, whose page it is."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_pages as P
from .base import blank_to_null, col, let, quoted_alternation, text
from .company import fold_width
from .text import unescape_html
from .urls import is_detail_url

LINK = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), F.lit(""))


def _whole_word(c: Column, words: str) -> Column:
    return c.rlike(f"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])")


def suffixes(host: Column) -> Column:
    """a.b.c, b.c and c of a host name, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def link_parts(url) -> Column:
    """host (lower case, without user and port), path (at least /), query and fragment with their signs; host is '' without one."""
    u = F.trim(text(url))
    for entity, sign in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        u = F.replace(u, F.lit(entity), F.lit(sign))

    def cut(s):
        part = lambda k: F.regexp_extract(s, LINK, k)
        return F.struct(s.alias("url"), F.lower(part(1)).alias("host"), F.when(part(2) == "", "/").otherwise(part(2)).alias("path"), part(3).alias("query"), part(4).alias("fragment"))
    return let(u, cut)


def link_keywords(plain: Column) -> Column:
    """Keywords of a lower-case address in their order of rank; one inside a keyword already found does not count."""
    def add(found, word):
        fresh = plain.contains(word) & ~F.exists(found, lambda f: f.contains(word))
        return F.when(fresh, F.array_append(found, word)).otherwise(found)
    return F.aggregate(F.array(*map(F.lit, P.LINK_KEYWORDS)), F.array().cast("array<string>"), add)


def host_company(host: Column) -> Column:
    """First label of a host, or the second behind a general one such as www or careers."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    first, second = F.get(labels, F.lit(0)), F.get(labels, F.lit(1))
    return F.when(first.isin(P.GENERIC_LABELS) & second.isNotNull(), second).otherwise(first)


def _spaced(c: Column) -> Column:
    # a path outside ASCII counts in its escaped form, which ends and starts like a word
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\x00-\x7F]+", "%AA"), r"[._/-]+", " ")


def classify_link(url, known=None) -> Column:
    """Source class of a link: struct(platform, stored_platform, source_type, company, confidence, reason, signal, keywords,
    reject_reason, parser, slug, rejected).

    The first class that fits wins: blocked boards, reposts and articles (unless the host is a known career site), recruiting
    platforms, known sites (``known``: (company, hosts) in order), boards with a stable address, career pages by their words.
    Hosts are looked up by their suffixes, so a rule holds for all subdomains. Invalid or missing links are rejected.
    """
    sites = {}
    for k, (company, hosts) in enumerate(P.KNOWN_SITES if known is None else known):
        for h in hosts:
            sites.setdefault(h, (k, company))
    table = F.create_map(*[F.lit(x) for h, (k, company) in sites.items() for x in (h, f"{k:06d}{company}")]) if sites else None
    under = lambda p, hosts: F.arrays_overlap(p["suffixes"], F.array(*map(F.lit, hosts)))

    def derive(p):
        ends = suffixes(p["host"])
        site = F.array_min(F.filter(F.transform(ends, lambda s: F.try_element_at(table, s)), lambda v: v.isNotNull())) if sites else F.lit(None).cast("string")
        words = link_keywords(F.lower(_decoded(F.concat_ws(" ", p["host"], p["path"], p["query"], p["fragment"]))))
        both = F.lower(F.concat_ws(" ", p["host"], p["path"]))
        return F.struct(
            p["url"].alias("url"), p["host"].alias("host"), p["path"].alias("path"), p["query"].alias("query"), ends.alias("suffixes"),
            F.substring(site, 7, 1000).alias("site"), words.alias("words"), both.alias("both"), _whole_word(_spaced(F.concat_ws(" ", p["host"], p["path"])), P.CAREER_WORDS).alias("career"),
            F.filter(F.split(p["path"], "/"), lambda x: x != "").alias("steps"), host_company(p["host"]).alias("own"))

    def judge(p):
        step = lambda i: F.get(p["steps"], F.lit(i))
        found = F.array_join(p["words"], " ")
        kind = F.when(found.rlike(P.CAMPUS_WORDS), "official_campus").when(found.rlike(P.SOCIAL_WORDS), "official_social_recruiting").otherwise("official_company_career")
        detail = is_detail_url(p["url"], F.lit("generic_official_detail"))
        none, no_words = F.lit(None).cast("string"), F.array().cast("array<string>")

        def made(platform, source_type, company, confidence, reason, signal=none, parser=none, slug=none, stored=None, words=p["words"], rejected=False):
            lit = lambda x: x if isinstance(x, Column) else F.lit(x)
            why = lit(reason)
            return F.struct(lit(platform).alias("platform"), lit(platform if stored is None else stored).alias("stored_platform"), lit(source_type).alias("source_type"),
                            company.alias("company"), lit(confidence).cast("double").alias("confidence"), why.alias("reason"), lit(signal).alias("signal"), words.alias("keywords"),
                            (why if rejected else none).alias("reject_reason"), lit(parser).alias("parser"), lit(slug).alias("slug"), F.lit(rejected).alias("rejected"))

        def blocked(name, reason):
            return made(name, name, p["own"], 0, P.REASONS[reason], stored="unknown", rejected=True)

        decoded = F.lower(F.concat_ws(" ", p["host"], _decoded(p["path"])))
        repost = under(p, P.REPOST_HOSTS) | (under(p, ["edu.cn"]) & decoded.rlike(P.UNIVERSITY_WORDS))
        article = F.lower(p["path"]).rlike(P.ARTICLE_PATH + r"(?![A-Za-z0-9_])") | (_whole_word(F.regexp_replace(p["both"], r"[^\x00-\x7F]+", "%AA"), P.SEO_SUBJECT) & p["both"].rlike(P.SEO_WORDS))
        free = p["site"].isNull()
        board = F.coalesce(step(0), p["own"])
        tenant = F.coalesce(step(1), board)
        moka, beisen = under(p, ["mokahr.com"]), under(p, ["italent.cn", "zhiye.com"])
        feishu = under(p, ["feishu.cn", "feishu-boe.cn", "larksuite.com"]) & p["career"]
        ats = lambda name, slug, parser=none, reason="china_ats": made(name, kind, slug, 0.82, P.REASONS[reason], f"china_ats:{name}", parser, slug, stored="official_careers")
        own_parser = F.coalesce(*[F.when((p["host"] == h) & p["path"].rlike(path), F.lit(name)) for name, h, path in P.OWN_PARSERS], F.when(detail, F.lit("generic_official_detail")))
        asked = blank_to_null(F.regexp_extract(p["query"], r"[?&]for=([^&]*)", 1))
        plain_board = p["host"].isin("job-boards.greenhouse.io", "boards.greenhouse.io")
        slug = F.when(plain_board, F.coalesce(step(0), asked)).otherwise(F.coalesce(asked, step(0)))
        one_job = F.array_contains(p["steps"], "jobs") & (F.size(p["steps"]) >= 3)
        two_steps = F.size(p["steps"]) >= 2
        pick = lambda cond, name: F.when(cond, P.REASONS[name + "_detail"]).otherwise(P.REASONS[name])
        high = lambda cond: F.when(cond, 0.95).otherwise(0.85)
        china = p["host"].endswith(".cn") | p["host"].contains("china") | _decoded(F.concat(p["path"], p["query"])).rlike("[一-鿿]")
        parsed = F.when(china & detail, F.lit("generic_official_detail"))
        ats_type = "official_ats"
        return (F.when(p["host"] == "", made("unknown", "unknown", none, 0, P.REASONS["invalid"], words=no_words, rejected=True))
                .when(free & under(p, P.THIRD_PARTY_HOSTS), blocked("third_party_job_board", "third_party"))
                .when(free & under(p, P.ARTICLE_HOSTS), blocked("content_article", "article"))
                .when(free & repost, blocked("campus_repost", "repost"))
                .when(free & article, blocked("content_article", "article"))
                .when(moka, ats("moka", tenant, "moka", "moka")).when(beisen, ats("beisen", board)).when(feishu, ats("feishu_recruit", board))
                .when(~free, made("official_careers", kind, p["site"], 0.85, P.REASONS["known"], "known_china_official_source", own_parser))
                .when(plain_board | p["host"].endswith(".greenhouse.io"), made("greenhouse", ats_type, slug, high(one_job), pick(one_job, "greenhouse"), "official_ats:greenhouse", "greenhouse", slug))
                .when(p["host"] == "jobs.lever.co", made("lever", ats_type, step(0), high(two_steps), pick(two_steps, "lever"), "official_ats:lever", "lever", step(0)))
                .when(p["host"].contains("myworkdayjobs.com"), made("workday", ats_type, p["own"], 0.75, P.REASONS["workday"], "official_ats:workday"))
                .when(p["host"] == "jobs.ashbyhq.com", made("ashby", ats_type, step(0), 0.75, P.REASONS["ashby"], "official_ats:ashby", none, step(0)))
                .when(p["host"].endswith("smartrecruiters.com"), made("smartrecruiters", ats_type, board, 0.75, P.REASONS["smartrecruiters"], "official_ats:smartrecruiters"))
                .when(p["career"], made("official_careers", kind, p["own"], F.when(parsed.isNotNull(), 0.72).otherwise(0.65), pick(parsed.isNotNull(), "career"), "career_keyword", parsed))
                .otherwise(made("unknown", "unknown", p["own"], 0.25, P.REASONS["unknown"])))

    return let(link_parts(url), lambda p: let(derive(p), judge))


def worth_recording(url, found: Column) -> Column:
    """Whether a classified link becomes a candidate source."""
    words = let(link_parts(url), lambda p: (p["host"] != "") & _whole_word(_spaced(F.concat_ws(" ", p["host"], p["path"])), P.HIRING_WORDS))
    return ~found["rejected"] & F.when(found["platform"] == "unknown", words).otherwise(found["confidence"] >= 0.5)


def china_signal(url, found: Column, city=None) -> Column:
    """Whether a classified link points to an official source in China, or in the asked city (its spellings, an array)."""
    def read(p):
        plain = F.regexp_replace(F.lower(_decoded(F.concat(p["host"], F.lit(" "), p["path"], p["query"]))), r"[._/-]+", " ")
        named = F.lit(False) if city is None else F.exists(F.coalesce(col(city), F.array().cast("array<string>")), lambda w: (w != "") & plain.contains(F.lower(w)))
        return (p["host"] != "") & ((found["signal"] == "known_china_official_source") | F.startswith(found["signal"], F.lit("china_ats:")) | p["host"].endswith(".cn")
                                    | p["host"].contains("china") | plain.rlike(P.CHINA_PLACES) | named)
    return ~found["rejected"] & F.coalesce(let(link_parts(url), read), F.lit(False))


def _platform(host: Column, path: Column) -> Column:
    """'platform adapter' of a host, null without a rule."""
    out = None
    for token, platform, adapter in P.PLATFORM_HOSTS:
        fits = (host == token) | host.endswith("." + token) if "." in token else F.array_contains(F.split(host, r"\."), token)
        name = F.lit(f"{platform} {adapter or ''}")
        if platform == "hotjob":
            name = F.when(path.contains("/wt/"), "wt wt").otherwise(name)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


TOKENS = quoted_alternation([t for t, _p, _a in P.PLATFORM_HOSTS])


def page_platform(url, html) -> Column:
    """struct(platform, adapter) of a page: by its own host, else the first host linked or named in it, else an interface address."""
    host_of = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, LINK, 1)), r"\.$", "")
    path_of = lambda u: F.lower(F.regexp_extract(u, LINK, 2))

    def read(body):
        u = text(url)
        low = F.lower(body)
        named = low.rlike(TOKENS)  # most pages name no platform and are scanned no further
        links = F.regexp_extract_all(body, F.lit(r"(?i)https?://[^\s\"'<>\\]+"), F.lit(0))
        linked = F.filter(F.transform(links, lambda x: _platform(host_of(F.regexp_replace(x, r"[);,]+$", "")), path_of(x))), lambda x: x.isNotNull())
        hosts = F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9-])(?:[a-z0-9-]++\.)+[a-z]{2,}(?![a-z0-9-])"), F.lit(0))
        bare = F.filter(F.transform(hosts, lambda h: _platform(h, F.lit(""))), lambda x: x.isNotNull())
        both = F.concat(F.lower(u), F.lit("\n"), low)
        interface = F.coalesce(*[F.when(both.contains(t), F.lit(f"{p} {a}")) for t, p, a in P.PLATFORM_INTERFACES])
        return F.coalesce(_platform(host_of(u), path_of(u)), F.when(named, F.get(linked, F.lit(0))), F.when(named, F.get(bare, F.lit(0))), interface, F.lit("unknown "))

    name = let(text(html), read)
    return let(name, lambda n: F.struct(F.substring_index(n, " ", 1).alias("platform"), blank_to_null(F.substring_index(n, " ", -1)).alias("adapter")))


def page_state(status, html) -> Column:
    """anti_bot, login_wall, no_stable_jd, unknown_spa, or null for a usable page."""
    def read(body):
        low = F.lower(body)
        job = low.rlike(P.JOB_SHAPE)
        refused = (low.contains("access denied") | low.contains("cloudflare challenge") | low.contains("cf-chl-")
                   | (low.contains("akamai") & (low.contains("challenge") | low.contains("denied"))) | (low.contains("请开启javascript") & ~low.contains("/api/")))
        login = low.rlike("<input[^>]+type=[\"']?password") & low.rlike(P.LOGIN_WORDS)
        notice = low.rlike("href=[\"'][^\"']+\\.pdf(?:[?#][^\"']*)?[\"']") & low.rlike(P.NOTICE_WORDS)
        return (F.when(F.coalesce(col(status).isin(P.BLOCKED_STATUS), F.lit(False)) | refused, "anti_bot").when(login & ~job, "login_wall").when(notice & ~job, "no_stable_jd")
                 .when(low.rlike("<div[^>]+id=[\"']app[\"']") | low.contains("__nuxt__") | low.contains("__next_data__"), "unknown_spa"))
    return let(text(html), read)


def _compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(fold_width(c)), r"[^\p{L}\p{N}]+", "")


def page_identity(company, url, html) -> Column:
    """struct(ok, reason): whether title or visible text name the company, by its whole name or its core without legal words.

    A core counts from two CJK characters, or three Latin ones where it has no CJK character.
    """
    def read(x):
        source, full = x["html"], x["full"]
        core = F.regexp_replace(full, "(?<=.)(?:" + quoted_alternation(P.IDENTITY_SUFFIXES) + ")+$", "")
        cjk, latin = F.regexp_count(core, F.lit("[一-鿿]")), F.regexp_count(core, F.lit("[a-z0-9]"))
        has_core = (core != full) & ((cjk >= 2) | ((cjk == 0) & (latin >= 3)))
        title = _compact(unescape_html(F.regexp_replace(F.regexp_extract(source, r"(?is)<title\b[^>]*>(.*?)</title>", 1), "(?s)<[^>]+>", " ")))
        visible = F.regexp_replace(F.regexp_replace(source, r"(?is)<(?:script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)>", " "), "(?s)<[^>]+>", " ")
        body = _compact(F.substring(unescape_html(visible), 1, P.IDENTITY_CHARS))
        host = F.translate(F.lower(F.regexp_extract(text(url), LINK, 1)), "-.", "")
        own = F.exists(F.regexp_extract_all(F.lower(x["company"]), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda w: host.contains(w))

        def found(t):
            named = lambda n: t["title"].contains(n) | t["body"].contains(n)
            kind = F.when((t["full"] != "") & named(t["full"]), "full").when(t["has_core"] & named(t["core"]), "core")
            return F.struct(kind.isNotNull().alias("ok"), F.coalesce(F.concat(F.lit("page_company_match:"), kind, F.when(t["own"], "+host_related").otherwise("")), F.lit("page_company_not_found")).alias("reason"))
        parts = F.struct(title.alias("title"), body.alias("body"), full.alias("full"), core.alias("core"), has_core.alias("has_core"), own.alias("own"))
        return F.when(F.trim(x["company"]) == "", F.struct(F.lit(True).alias("ok"), F.lit("company_not_provided").alias("reason"))).otherwise(let(parts, found))
    return let(F.struct(text(html).alias("html"), text(company).alias("company"), _compact(text(company)).alias("full")), read)


def looks_like_recruiting(html) -> Column:
    """A page with the shape of a posting list, or with at least two recruiting words in its visible text."""
    words = r"(招聘|社会招聘|校园招聘|职位|岗位|人才|加入我们|工作机会|(?<![A-Za-z0-9_])(?:careers?|jobs?|recruit(?:ment|ing)?|talent)(?![A-Za-z0-9_]))"

    def read(source):
        visible = F.regexp_replace(F.regexp_replace(source, r"(?is)<(?:script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)>", " "), "(?s)<[^>]+>", " ")
        return F.lower(source).rlike(P.JOB_SHAPE) | (F.regexp_count(F.lower(F.substring(unescape_html(visible), 1, 12000)), F.lit(words)) >= 2)
    return let(text(html), read)
