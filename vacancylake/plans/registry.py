"""Named queries over the given tables, each with an equivalent SQL statement where one exists."""
from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .roles import ROLE_SQL, TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The role tables of one data folder, made on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.counts: dict[str, int] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        for f in df.schema.fields:
            if f.dataType.simpleString() == "timestamp_ntz":
                df = df.withColumn(f.name, df[f.name].cast("timestamp"))
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.base(name)
        key = "r_" + name
        if key not in ROLE_SQL:
            raise AttributeError(name)
        return self.sql(ROLE_SQL[key])

    def rows(self, name: str) -> int:
        """Rows of a given table, counted once (from the footers of its files)."""
        if name not in self.counts:
            self.counts[name] = self.base(name).count()
        return self.counts[name]

    def sql(self, text: str) -> DataFrame:
        # Spark never runs a subquery in the key of a side it broadcasts ("Subquery has not finished"), so counts are told as values
        text = re.sub(r"\(select count\(\*\) from \{(\w+)\}\)", lambda m: f"{self.rows(m[1])}L" if m[1] in TABLES else m[0], text)
        names = set(re.findall(r"\{(\w+)\}", text))
        frames = {n: (self.base(n) if n in TABLES else getattr(self, n[2:])) for n in names}
        return self.spark.sql(text, **frames)


def _oracle(body: str) -> str:
    """Prefix a statement with the role tables it names, in dependency order."""
    order: list[str] = []

    def need(text: str):
        for name in ROLE_SQL:
            if re.search(rf"\b{name}\b", text) and name not in order:
                if name != current[-1]:
                    current.append(name)
                    need(ROLE_SQL[name])
                    current.pop()
                    if name not in order:
                        order.append(name)

    current = [""]
    need(body)
    ctes = ["%s as (%s)" % (n, re.sub(r"\{(\w+)\}", r"\1", ROLE_SQL[n]).replace("{{", "{").replace("}}", "}"))
            for n in order]
    body = body.strip()
    if body[:5].lower() == "with ":
        head, body = body[5:], ""
        return "with " + ", ".join(ctes + [head]) if ctes else "with " + head
    return ("with " + ", ".join(ctes) + " " if ctes else "") + body


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``, ``t`` being the role tables, under a name."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = _oracle(sql)
        return fn
    return wrap
