"""SQL-callable forms, inlined by the optimizer."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values are spelled once in ``fixed``; the SQL bodies are built from them
from . import fixed as V


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def register(spark: SparkSession) -> None:
    """canonical_url, search_tokens and source_board as temporary SQL functions."""
    keys = _list(V.TRACKING_KEYS)
    spark.sql(rf"""create or replace temporary function canonical_url(u string) returns string return
      case when u is null or trim(u) = '' or contains(u, '#') then trim(u) else
        rtrim('?', concat_ws('?', regexp_replace(substring_index(trim(u), '?', 1), '/+$', ''),
          array_join(filter(split(case when contains(u, '?') then substr(trim(u), instr(trim(u), '?') + 1) else '' end, '&'),
            p -> p <> '' and not startswith(lower(substring_index(p, '=', 1)), '{V.TRACKING_PREFIX}')
                 and not array_contains(array({keys}), lower(substring_index(p, '=', 1)))), '&'))) end""")
    spark.sql(r"""create or replace temporary function search_tokens(t string) returns array<string> return
      flatten(transform(filter(split(lower(coalesce(t, '')), '\\s+'), w -> w <> ''), w -> case when w rlike '^[a-z0-9]+$' or length(w) = 1
        then array(w) else transform(sequence(1, length(w) - 1), i -> substr(w, i, 2)) end))""")
    spark.sql(f"""create or replace temporary function source_board(adapter string, url string) returns string return
      case when coalesce(adapter, '') in ({_list(V.MIXED_BOARD_ADAPTERS)}) then 'mixed' when coalesce(adapter, '') = 'bytedance_campus' then 'campus'
        when lower(coalesce(url, '')) like '%off-campus%' then 'social'
        when lower(coalesce(url, '')) rlike 'campus|/school|school[.]html|/grad|university|xiaozhao' then 'campus'
        when lower(coalesce(url, '')) rlike 'intern|shixi' then 'intern' else 'social' end""")


def active_companies(spark: SparkSession, view: str) -> DataFrame:
    """Distinct companies with active postings of a view."""
    return spark.table(view).where("status = 'active' and company <> ''").select("company").distinct()


def active_counts(spark: SparkSession, view: str) -> DataFrame:
    from pyspark.sql import functions as F
    rows = spark.table(view).where("status = 'active' and trim(company) <> '' and length(trim(summary)) >= 60")
    return rows.groupBy(F.trim("company").alias("company")).agg(F.count("*").alias("job_count"))
