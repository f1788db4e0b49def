"""Golden rows of the column functions."""
import pytest

from vacancylake.functions import company as CO, dates as D, geo as G, text as T, tokens as K, urls as U


@pytest.mark.parametrize("url,want", [
    ("https://a.com/x/?utm_source=1&id=2", "https://a.com/x?id=2"), ("https://a.com/x//", "https://a.com/x"),
    ("https://a.com/#/job/1?spm=2", "https://a.com/#/job/1?spm=2"), ("  ", ""), ("https://a.com/?SPM=1", "https://a.com"), (None, None)])
def test_canonical_url(one, url, want):
    assert one(lambda: U.canonical_url("u"), u=url) == want


@pytest.mark.parametrize("text,want", [("数据 分析师 go", ["数据", "分析", "析师", "go"]), ("C++ 1", ["c+", "++", "1"]), ("", [])])
def test_search_tokens(one, text, want):
    assert one(lambda: K.search_tokens("t"), t=text) == want


def test_query_tokens_drop_signs(one):
    assert one(lambda: K.query_tokens("t"), t="c++ 产 产品 go") == ["产", "产品", "go"]


@pytest.mark.parametrize("pay,want", [("15-30K", (15, 30)), ("15000-30000", (15, 30)), ("15-30万", None), ("面议", None)])
def test_monthly_pay(one, pay, want):
    got = one(lambda: T.monthly_k("p"), p=pay)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("kind,title,want", [("社招", "x", "social"), (None, "Software Engineer Intern", "intern"), (None, "资深产品经理", "unknown")])
def test_recruit_bucket(one, kind, title, want):
    assert one(lambda: T.recruit_bucket("k", "t"), k=kind, t=title) == want


@pytest.mark.parametrize("loc,want", [("Taipei, Taiwan, Province of China", "TW"), ("Hong Kong", "HK"), ("上海市", "CN"), ("New York, NY", "US"),
                                      ("Sydney", None), ("Austin", "US"), ("Focus", None)])
def test_country(one, loc, want):
    assert one(lambda: G.country_code("l"), l=loc) == want


@pytest.mark.parametrize("name,token,want", [("陕西圆通速递", "圆通", True), ("北京华晋中通电力", "中通", False), ("北京京东方松彩", "京东方", True)])
def test_name_attribution(one, name, token, want):
    assert one(lambda: CO.name_matches("n", "t"), n=name, t=token) is want


def test_company_suffix_order(one):
    assert one(lambda: CO.cover_key("n"), n="字节 跳动股份有限公司") == "字节跳动"
    assert one(lambda: CO.cover_key("n"), n="集团") == "集团"


@pytest.mark.parametrize("text,want", [("2026/2027届均可", 2027), ("欢迎27届同学", 2027), ("2027年12月前入职", None), ("Class of 2026", 2026)])
def test_grad_class(one, text, want):
    assert one(lambda: T.grad_class("t", None, None), t=text) == want


@pytest.mark.parametrize("text,want", [("2026-09-01", "2026-09-01"), ("长期有效", None), ("9月1日截止", "2026-09-01"), ("2026-09-01 至 2026-10-01", None), ("1月5日", "2027-01-05")])
def test_deadline(one, text, want):
    got = one(lambda: D.parse_deadline("t", "2026-08-01 00:00:00")["date"], t=text)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize("text,want", [("3年以上工作经验", 3), ("大学3年级在读", None), ("5+ years", 5), ("资深senior工程师", 5), ("经验丰富，2-4年", 2)])
def test_min_years(one, text, want):
    assert one(lambda: T.min_years("t"), t=text) == want


def test_edges_next_to_cjk(one):
    # the written word counts even when a CJK character stands next to it
    assert one(lambda: T.recruitment_category("t", None, None, None, None), t="产品intern实习") == "实习"
    assert one(lambda: T.job_function("t", None), t="机械工程师") == "其他"
    assert one(lambda: T.job_function("t", None), t="机械软件工程师") == "研发"


@pytest.mark.parametrize("need,want,verdict", [("硕士优先，本科及以上", "本科", "pass"), ("博士", "硕士", "reject"), ("", "本科", "degrade"), ("其他", "本科", "degrade")])
def test_education(one, need, want, verdict):
    assert one(lambda: T.education_match("n", "w"), n=need, w=want) == verdict


def test_summary_is_cut_at_a_word(one):
    got = one(lambda: T.clean_summary("s", 18), s="&amp;lt;p&amp;gt;alpha beta gamma delta epsilon&amp;lt;/p&amp;gt;")
    assert got == "alpha beta gamma…"


def test_job_posting_dates(one):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","datePosted":"2026-05-01","validThrough":"2026-06-01T00:00"}]}</script>'
    assert tuple(one(lambda: D.jobposting_dates("h"), h=html)) == ("2026-05-01", "2026-06-01")


def test_location_list(one):
    assert one(lambda: G.normalize_location("l"), l="Beijing, 上海市") == "北京、上海"
    assert one(lambda: G.normalize_location("l"), l="San Francisco, CA") == "San Francisco, CA"
