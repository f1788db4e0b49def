"""Validation jobs: good rows and rejects with a reason."""
from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import any_of, at, col, let, squeeze, text
from ..functions.scoring import unique_strings

# fixed values: direct identifiers of people
SURNAMES = ("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文")
PII = [r"(?:\+?86[-\s]?)?1[3-9]\d[-\s]?\d{4}[-\s]?\d{4}", r"(?<![A-Za-z0-9_])\d{17}[\dXx](?![A-Za-z0-9_])", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
       r"(?:^|\s)@[A-Za-z0-9_\-一-龥]{2,}", "[" + SURNAMES + "](?:总监|经理|主管|老板|老师|总|姐|哥)", "张三|李四|王五|赵六"]
CONTENT_MAX = 200
# fixed values: payload keys that are never stored, compared after trimming, lower-casing and joining words by _
FORBIDDEN_KEYS = ["email", "user_email", "contact_email", "resume", "resume_text", "raw_resume", "reason_text", "title", "job_title", "company", "company_name", "jd_url", "skills"]


def contains_pii(c) -> Column:
    return any_of(text(c).rlike(p) for p in PII)


def validate_submissions(df: DataFrame, max_chars: int | None = CONTENT_MAX) -> DataFrame:
    """Adds reason: the first thing wrong with a report, null for a good one."""
    content = squeeze("content")
    bad_rating = F.col("rating").isNotNull() & ~F.col("rating").between(1, 5)
    long = (F.length("_c") > max_chars) if max_chars else F.lit(False)
    return df.withColumn("_c", content).withColumn("reason", F.when(F.trim(text("company")) == "", "missing_company").when(bad_rating, "invalid_rating")
        .when(text("_c") == "", "content_required").when(long, "content_too_long").when(contains_pii("_c"), "pii_detected")
        .when(~F.coalesce("consent", F.lit(False)), "consent_required")).drop("_c")


def validate_preferences(df: DataFrame, max_items: int = 30, max_chars: int = 80) -> DataFrame:
    """Clean list values, clamp the daily number, reject unknown enums; column reason."""
    lists = [c for c, t in df.dtypes if t == "array<string>"]
    too_many = any_of(F.coalesce(F.size(c) > max_items, F.lit(False)) for c in lists)
    too_long = any_of(F.coalesce(F.exists(c, lambda v: F.length(v) > max_chars), F.lit(False)) for c in lists)
    enum = ~F.coalesce("job_scope", F.lit("domestic")).isin("domestic", "overseas", "all")
    out = df.withColumn("reason", F.when(enum, "invalid_scope").when(too_many, "too_many_values").when(too_long, "value_too_long"))
    for c in lists:
        out = out.withColumn(c, unique_strings(c))
    return out.withColumn("daily_limit", F.greatest(F.lit(5), F.least(F.lit(30), F.coalesce("daily_limit", F.lit(20)))))


def validate_actions(df: DataFrame, known=("viewed", "saved", "ignored", "applied")) -> DataFrame:
    return df.withColumn("reason", F.when(text("job_id") == "", "missing_job").when(~text("action").isin(list(known)), "invalid_action"))


def _without(value, forbidden: frozenset):
    if isinstance(value, list):
        return [_without(v, forbidden) for v in value]
    if not isinstance(value, dict):
        return value
    return {k: _without(v, forbidden) for k, v in value.items() if re.sub(r"[\s-]+", "_", k.strip().lower()) not in forbidden}


def safe_payload(c, forbidden=FORBIDDEN_KEYS, max_chars: int = 4000) -> Column:
    """JSON object without forbidden keys at any depth; {} for anything else and for what stays too long."""
    drop = frozenset(forbidden)

    @F.pandas_udf("string")
    def clean(payloads: pd.Series) -> pd.Series:
        out = []
        for p in payloads:
            try:
                value = json.loads(p) if p else {}
            except ValueError:
                value = {}
            body = json.dumps(_without(value, drop), ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else "{}"
            out.append(body if len(body) <= max_chars else "{}")
        return pd.Series(out, dtype=object)

    return clean(col(c))


def judge_events(df: DataFrame, max_name: int = 64) -> DataFrame:
    """Adds reason: event_missing, event_too_long, or null for a good row; names are trimmed, not changed."""
    name = F.trim(text("event"))
    return df.withColumn("event", name).withColumn("reason", F.when(F.col("event") == "", "event_missing").when(F.length("event") > max_name, "event_too_long"))


def clean_events(df: DataFrame, max_name: int = 64, max_payload: int = 4000, forbidden=FORBIDDEN_KEYS) -> DataFrame:
    """Events with a good name, and payloads without forbidden keys."""
    return judge_events(df, max_name).where("reason is null").drop("reason").withColumn("payload", safe_payload("payload", forbidden, max_payload))


def validate_cycle_claims(df: DataFrame, now) -> DataFrame:
    n = F.to_date(at(now))
    ok_month = F.col("month_start").between(1, 12) & F.coalesce("month_end", "month_start").between(1, 12)
    return df.withColumn("reason", F.when(~F.col("season").isin("秋招", "春招"), "invalid_season").when(~F.col("batch").isin("提前批", "正式批", "补录", "实习转正"), "invalid_batch")
        .when(~F.coalesce(ok_month, F.lit(False)), "invalid_month").when(text("publisher") == "", "missing_evidence")
        .when(F.abs(F.datediff("date_start", n)) > 1095, "date_out_of_window"))
