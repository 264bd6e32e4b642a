"""Registered queries: a name, the Spark query and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain_counts(sql: str) -> str:
    """count_if(x) as a plain count: the check database widens count_if to 128 bits."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            return "".join(out) + sql[i:]
        depth, k = 1, j + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "count(CASE WHEN " + plain_counts(sql[j + len("count_if(") : k - 1]) + " THEN 1 END)")
        i = k


def query(name: str, sql: str | None = None):
    """Registers the decorated (spark, folder) -> DataFrame under a name."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = plain_counts(sql)
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
