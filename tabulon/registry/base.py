"""How a query is registered, and what the registered queries share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.functions.rounding import GUARD_DIGITS
from tabulon.session import scratch_path, spread  # noqa: F401

# The SQL dialect rounds after a multiplication, which may move a half; decimals do not.
_ROUND = re.compile(r"\bround\(")


def exact_rounding(sql: str) -> str:
    """``round(x, n)`` written as a rounding of decimals, from the innermost call outwards."""
    start = len(sql)
    while (found := _last_before(sql, start)) is not None:
        start = found.start()
        depth, comma, at = 1, -1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            comma = at if sql[at] == "," and depth == 1 else comma
            at += 1
        inner, digits = sql[found.end() : comma], int(sql[comma + 1 : at - 1])
        call = f"CAST(round(CAST({inner} AS DECIMAL(38, {digits + GUARD_DIGITS})), {digits}) AS DOUBLE)"
        sql = sql[:start] + call + sql[at:]
    return sql


def _last_before(sql: str, end: int) -> re.Match | None:
    found = None
    for found in _ROUND.finditer(sql, 0, end):
        pass
    return found


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its reference SQL when SQL can express it."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = exact_rounding(sql)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts, over all cores where the scan alone would use fewer."""
    return spread(table(spark, folder, name))
