"""Company facts in stored JSON: public entities, exchange filings, reported figures, stock lists."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, functions as F

from .base import blank_to_null, col, let, text

# fixed values: entity properties, exchanges by entity, concepts and forms of annual reports, legal suffixes of stock names
PUBLIC_COMPANY = ["Q891723"]
EXCHANGES = {
    "Q13677": "纽交所", "Q82059": "纳斯达克", "Q174687": "纳斯达克", "Q739514": "港交所", "Q496672": "港交所", "Q1377551": "港交所",
    "Q517750": "上交所", "Q2038986": "深交所", "Q1547564": "上交所", "Q11705": "纽交所", "Q487907": "伦交所", "Q200402": "东京证交所",
}
REVENUE_CONCEPTS = ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"]
INCOME_CONCEPT, EMPLOYEE_CONCEPT = "NetIncomeLoss", "EntityNumberOfEmployees"
ANNUAL_FORMS = ["10-K", "20-F", "40-F"]
STOCK_SUFFIXES = ["股份有限公司", "有限公司", "集团股份", "控股集团", "股份", "集团", "控股", "公司"]
FILINGS_URL = "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK={cik}&type=&dateb=&owner=include&count=40"
TICKERS_URL = "https://www.sec.gov/files/company_tickers.json"
STOCK_URL = "http://www.cninfo.com.cn/new/disclosure/stock?stockCode={code}&orgId={org}"

ENTITY = "struct<id:string,labels:map<string,struct<value:string>>,claims:map<string,array<struct<mainsnak:struct<datavalue:struct<value:variant>>,qualifiers:map<string,array<struct<datavalue:struct<value:variant>>>>>>>>"
FIGURES = "map<string,struct<units:map<string,array<struct<fy:long,fp:string,form:string,val:variant,`end`:string>>>>>"
REPORT = f"struct<facts:struct<`us-gaap`:{FIGURES},dei:{FIGURES}>>"
SUBMISSIONS = "struct<name:string,cik:string,exchanges:array<string>,tickers:array<string>,filings:struct<recent:struct<form:array<string>,filingDate:array<string>>>>"

LISTING = "struct<content:string,status:string,exchange:string,ticker:string,origin:string,source_url:string,source_publisher:string,title:string,latest_form:string,latest_filing_date:string>"


def _values(entity: Column, prop: str) -> Column:
    claims = F.coalesce(F.try_element_at(entity["claims"], F.lit(prop)), F.array().cast("array<struct<mainsnak:struct<datavalue:struct<value:variant>>,qualifiers:map<string,array<struct<datavalue:struct<value:variant>>>>>>"))
    return claims


def _some(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _value(claim: Column) -> Column:
    return claim["mainsnak"]["datavalue"]["value"]


def items(entity: Column, prop: str) -> Column:
    """Entities a property names, in order."""
    return _some(F.transform(_values(entity, prop), lambda c: F.when(F.schema_of_variant(_value(c)).startswith("OBJECT"), F.nullif(F.try_variant_get(_value(c), "$.id", "string"), F.lit("")))))


def strings(entity: Column, prop: str) -> Column:
    return _some(F.transform(_values(entity, prop), lambda c: F.when(F.schema_of_variant(_value(c)) == "STRING", F.try_variant_get(_value(c), "$", "string"))))


def _year(time: Column) -> Column:
    return F.nullif(F.regexp_extract(time, r"^[+-](\d{4})", 1), F.lit("")).cast("int")


def first_year(entity: Column, prop: str) -> Column:
    """First year after 1800 that a property gives."""
    years = F.transform(_values(entity, prop), lambda c: _year(F.try_variant_get(_value(c), "$.time", "string")))
    return F.get(F.filter(years, lambda y: y > 1800), F.lit(0))


def employees(entity: Column) -> Column:
    """Head count of the latest point in time; the last of equal times, undated ones count as earliest."""
    def read(c, i):
        at = F.filter(F.transform(F.try_element_at(c["qualifiers"], F.lit("P585")), lambda q: _year(F.try_variant_get(q["datavalue"]["value"], "$.time", "string"))), lambda y: y.isNotNull())
        n = F.try_variant_get(_value(c), "$.amount", "string").try_cast("double").cast("long")
        return F.when(n.isNotNull(), F.struct(F.coalesce(F.get(at, F.size(at) - 1), F.lit(0)).alias("year"), i.alias("i"), n.alias("n")))
    return F.array_max(_some(F.transform(_values(entity, "P1128"), read)))["n"]


def entity_facts(entity_json) -> Column:
    """What an entity's JSON states, references to other entities unresolved; null where it is no entity."""
    def read(e):
        label = F.coalesce(*[F.nullif(F.try_element_at(e["labels"], F.lit(lang))["value"], F.lit("")) for lang in ("zh-hans", "zh", "en")], e["id"])
        exchange = items(e, "P414")
        return F.struct(e["id"].alias("qid"), label.alias("label"), F.concat(F.lit("https://www.wikidata.org/wiki/"), e["id"]).alias("entity_url"),
                        ((F.size(exchange) > 0) | F.arrays_overlap(items(e, "P31"), F.array(*map(F.lit, PUBLIC_COMPANY)))).alias("listed"), F.get(strings(e, "P249"), F.lit(0)).alias("ticker"),
                        F.get(strings(e, "P856"), F.lit(0)).alias("official_site"), first_year(e, "P571").alias("founded_year"), employees(e).alias("employees"),
                        exchange.alias("exchange_ids"), items(e, "P159").alias("hq_ids"), items(e, "P452").alias("industry_ids"))
    return let(F.from_json(col(entity_json), ENTITY), lambda e: F.when(e.isNotNull(), read(e)))


def known_exchange(qid) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXCHANGES.items() for x in kv]), col(qid))


def _listing(content, title, origin, publisher, url, status=None, exchange=None, ticker=None, form=None, filed=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(lit(content).alias("content"), lit(status).alias("status"), lit(exchange).alias("exchange"), lit(ticker).alias("ticker"), lit(origin).alias("origin"), lit(url).alias("source_url"),
                    lit(publisher).alias("source_publisher"), lit(title).alias("title"), lit(form).alias("latest_form"), lit(filed).alias("latest_filing_date"))


def entity_listing(f: Column) -> Column:
    """Listing claim of resolved facts (label, listed, exchanges, ticker, founded_year, entity_url); null without a sign either way."""
    ex, ticker = F.array_join(f["exchanges"], "/"), F.nullif(f["ticker"], F.lit(""))
    named = F.size(f["exchanges"]) > 0
    where = F.when(named, F.array_join(f["exchanges"], "、")).otherwise("公开市场")
    tail = F.when(ticker.isNotNull() & named, F.concat(F.lit("（"), ex, F.lit(" "), ticker, F.lit("）"))).when(ticker.isNotNull(), F.concat(F.lit("（代码 "), ticker, F.lit("）"))).otherwise("")
    told = F.when(f["listed"], F.concat(F.lit("据 Wikidata 公开资料，"), f["label"], F.lit(" 为已上市公司，挂牌于"), where, tail, F.lit("。"))).otherwise(
        F.concat(F.lit("据 Wikidata 公开资料，"), f["label"], F.lit(" 当前未见公开上市记录（未上市 / 未在主要交易所挂牌）。")))
    made = _listing(told, "上市状态 · 据公开资料", "wikidata", "Wikidata", f["entity_url"], F.when(f["listed"], "listed").otherwise("private"), F.nullif(ex, F.lit("")), f["ticker"])
    return F.when(f["listed"] | (F.coalesce(f["founded_year"], F.lit(0)) != 0), made)


def ticker_key(c) -> Column:
    """Ticker without an exchange prefix, in capitals."""
    return F.upper(F.trim(F.element_at(F.split(text(c), ":"), -1)))


def filing_listing(submissions_json, ticker) -> Column:
    """Listing claim of a filer's JSON; null without a name or an exchange. The latest filing is the first of its date."""
    def read(s):
        names = F.array_distinct(F.filter(F.coalesce(s["exchanges"], F.array().cast("array<string>")), lambda x: text(x) != ""))
        recent = s["filings"]["recent"]
        dated = F.filter(F.transform(F.arrays_zip(recent["form"].alias("form"), recent["filingDate"].alias("day")), lambda z, i: F.struct(z["day"].alias("day"), (-i).alias("i"), z["form"].alias("form"))),
                         lambda z: (text(z["day"]) != "") & (-z["i"] < F.least(F.size(recent["form"]), F.size(recent["filingDate"]))))
        last = F.array_max(dated)
        code = F.coalesce(F.nullif(ticker_key(ticker), F.lit("")), F.get(s["tickers"], F.lit(0)))
        cik, name = F.trim(text(s["cik"])), F.trim(text(s["name"]))
        fresh = F.when((text(last["form"]) != "") & last["day"].isNotNull(), F.concat(F.lit("，最新申报 "), last["form"], F.lit("（"), last["day"], F.lit("）"))).otherwise("")
        told = F.concat(F.lit("据 SEC EDGAR 官方披露，"), name, F.lit(" 在美国证监会持续申报"), fresh, F.lit("，挂牌于 "), F.array_join(names, "/"), F.lit("（代码 "), F.coalesce(code, F.lit("None")), F.lit("）。"))
        url = F.when(cik != "", F.replace(F.lit(FILINGS_URL), F.lit("{cik}"), cik)).otherwise(TICKERS_URL)
        return F.when((name != "") & (F.size(names) > 0), _listing(told, "上市状态 · SEC 官方披露", "official", "SEC EDGAR", url, "listed", F.array_join(names, "/"), code, last["form"], last["day"]))
    return let(F.from_json(col(submissions_json), SUBMISSIONS), read)


def _number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))


def _entries(figures: Column, concept: str, unit: str) -> Column:
    listed = F.try_element_at(F.try_element_at(figures, F.lit(concept))["units"], F.lit(unit))
    return F.coalesce(listed, F.array().cast("array<struct<fy:bigint,fp:string,form:string,val:variant,`end`:string>>"))


def annual_series(figures: Column, concept: str, unit: str = "USD") -> Column:
    """Annual values of a concept as (end, i, fy, val), by end of the year; of one end the last entry counts last."""
    rows = F.transform(_entries(figures, concept, unit), lambda x, i: F.struct(x["end"].alias("end"), i.alias("i"), x["fy"].alias("fy"), _number(x["val"]).alias("val"), ((x["fp"] == "FY") & x["form"].isin(ANNUAL_FORMS)).alias("annual")))
    return F.array_sort(F.filter(rows, lambda r: r["annual"] & r["val"].isNotNull() & (text(r["end"]) != "")))


def reported_figures(report_json) -> Column:
    """struct(fy, revenue, net_income, revenue_yoy_pct, employees) of the last annual report; null if the JSON holds none of them.

    Revenue is taken from the first concept with an annual value; its change on the entry before is rounded half to even.
    """
    def read(r):
        gaap = r["facts"]["us-gaap"]
        series = [annual_series(gaap, c) for c in REVENUE_CONCEPTS]
        rev = F.coalesce(*[F.when(F.size(s) > 0, s) for s in series])
        people = F.filter(F.transform(_entries(r["facts"]["dei"], EMPLOYEE_CONCEPT, "pure"), lambda x: F.struct(x["end"].alias("end"), _number(x["val"]).alias("val"))), lambda x: x["val"].isNotNull() & (text(x["end"]) != ""))
        return F.struct(rev.alias("rev"), annual_series(gaap, INCOME_CONCEPT).alias("ni"), F.array_max(people)["val"].cast("long").alias("people"))

    def finish(x):
        last = lambda s, k: F.get(s, F.size(s) - k)
        now, before, ni = last(x["rev"], 1), last(x["rev"], 2), last(x["ni"], 1)
        yoy = F.when(before["val"] != 0, F.bround((now["val"] - before["val"]) / F.abs(before["val"]) * 100, 0).cast("long"))
        made = F.struct(F.coalesce(F.when(now.isNotNull(), now["fy"]).otherwise(ni["fy"])).alias("fy"), now["val"].alias("revenue"), ni["val"].alias("net_income"), yoy.alias("revenue_yoy_pct"), x["people"].alias("employees"))
        return F.when(now.isNotNull() | ni.isNotNull() | x["people"].isNotNull(), made)
    return let(let(F.from_json(col(report_json), REPORT), read), finish)


def exchange_of_code(code) -> Column:
    c = F.trim(text(code))
    two, one = F.substring(c, 1, 2), F.substring(c, 1, 1)
    return F.when(two.isin("60", "68"), "上交所").when(two.isin("00", "30"), "深交所").when(one.isin("8", "4") | (two == "92"), "北交所").otherwise("")


def stock_name_key(c) -> Column:
    """Name without the first legal suffix (of STOCK_SUFFIXES, in order) that ends it."""
    s = F.trim(text(c))
    out = None
    for suffix in STOCK_SUFFIXES:
        cut = F.trim(F.substring(s, F.lit(1), F.length(s) - len(suffix)))
        out = F.when(s.endswith(suffix), cut) if out is None else out.when(s.endswith(suffix), cut)
    return out.otherwise(s)


def stock_listing(code, name, org) -> Column:
    c, n = F.trim(text(code)), F.trim(text(name))
    market = F.coalesce(F.nullif(exchange_of_code(c), F.lit("")), F.lit("A股"))
    told = F.concat(F.lit("据巨潮资讯网（中国证监会指定披露平台），"), n, F.lit(" 为 A 股上市公司，股票代码 "), c, F.lit("（"), market, F.lit("）。"))
    url = F.replace(F.replace(F.lit(STOCK_URL), F.lit("{code}"), c), F.lit("{org}"), F.trim(text(org)))
    return F.when((c != "") & (n != ""), _listing(told, "上市状态 · 巨潮资讯（官方披露）", "official", "巨潮资讯", url, "listed", market, c))


def profile_columns(f: Column, band: Column) -> Column:
    """Profile columns that resolved facts fill; missing facts stay null."""
    return F.struct(F.nullif(f["founded_year"], F.lit(0)).alias("founded_year"), band.alias("headcount_band"), blank_to_null(f["hq"]).alias("hq_location"),
                    F.when(f["listed"], "已上市").otherwise("未上市/未披露").alias("funding_stage"))
