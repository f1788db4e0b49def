"""Verdicts for page URLs: a blocked Bloom filter of listed keys, then an exact hash join."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.common import LOWER, UPPER

WORDS = 8  # 32-bit words of a filter block; a key sets one bit in each
KEYS_PER_BLOCK = 16  # 256 bits for 16 keys: 16 bits a key, about one false positive in a thousand


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a text without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def canonical(host: Column, path: Column) -> Column:
    """One spelling of a page: host without www. or m., path without .html and closing slashes."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/+)$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * k).bitwiseAND(31).cast("int")) for k in range(WORDS)]


def bloom(keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """(block, w0..w7): the filter as a table, one row per block that is not empty."""
    masks = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_bits(F.col(key)))])
    return masks.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(probes: DataFrame, filter_table: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """Rows of probes whose key may be in the filter: all true hits, few others."""
    out = probes.columns
    p = probes.select("*", _block(F.col(key), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_bits(F.col(key)))])
    p = p.join(filter_table, "block")
    for i in range(WORDS):
        p = p.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    return p.select(*out)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of pages, repeated rows included.

    rules: (action, host, path), a short configuration list. A rule fits its host and all subdomains if the path starts
    with the rule's path; the longest rule text wins, then the longer host. listed: a table of any size with a column
    `key` of canonical URLs (see `canonical`); a page without a rule is blocked if its canonical URL is listed and
    allowed otherwise. Null or unparsable URLs have empty host and path and are allowed; null ids stay null; an empty
    table gives an empty result. Other columns of pages are not read, so their names cannot clash.

    All keys, rules and URLs alike, go into one blocked Bloom filter kept as a table. Distinct (host, path) pairs are
    probed by a join on the block; only possible hits reach the exact join on the key.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule_rows = [("r:" + h.lower() + p, h.lower() + p, len(h), a) for a, h, p in rules]
    rule_keys = spark.createDataFrame(rule_rows, "key string, rule string, host_len int, action string")
    url_keys = listed.where("key is not null").select(F.concat(F.lit("u:"), "key").alias("key")).distinct()
    keys = rule_keys.unionByName(url_keys.select("key", F.lit(None).cast("string").alias("rule"), F.lit(0).alias("host_len"), F.lit("block").alias("action")))
    blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = sorted({len(p) for _, _, p in rules})
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    prefixed = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(F.lit("r:"), s, p))))
    own = F.array(F.concat(F.lit("u:"), canonical(F.col("host"), F.col("path"))))
    probes = places.where("host <> ''").select("host", "path", F.explode(F.array_union(own, prefixed)).alias("key"))
    hits = possible_hits(probes, bloom(keys, blocks), blocks).join(keys, "key")
    best = F.struct(F.col("rule").isNotNull().alias("is_rule"), F.length("rule").alias("n"), "host_len", "rule", "action")
    found = hits.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(best).alias("best"))
    return rows.join(found, (rows.host == found.h) & (rows.path == found.p), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))
