"""Writing results: tables with their origin, reports, logs, keyed upserts."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tabulon.errors import EmptyInput
from tabulon.functions.schema import col, require_columns
from tabulon.operators.explore import query_counts, run_query
from tabulon.operators.joins import unique_keys
from tabulon.operators.report import long_form
from tabulon.operators.samples import head_sample
from tabulon.plans.specs import Plan, QuerySpec


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All rows with a header; null becomes an empty cell. Quotes are doubled; a cell with a quote, a
    comma or a line break is quoted."""
    plain = df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
    plain.option("nullValue", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)


def write_query_json(df: DataFrame, spec: QuerySpec, path: str, mode: str = "errorifexists") -> dict[str, Any]:
    """The full result of a query as JSON lines, with one row about it beside them."""
    result = run_query(df, spec)
    result.write.mode(mode).option("ignoreNullFields", False).json(f"{path}/rows")
    counts = query_counts(df, spec).first()
    meta = {"mode": spec.mode, **counts.asDict(), "group_by": list(spec.group_by), "columns": result.columns}
    df.sparkSession.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(
        1
    ).write.mode(mode).text(f"{path}/meta")
    return meta


def save_derived(
    df: DataFrame,
    path: str,
    kind: str,
    sources: Sequence[str],
    steps: Sequence[str] = (),
    rows_before: int | None = None,
    mode: str = "errorifexists",
) -> dict[str, Any]:
    """Write a derived table and, beside it, where it came from.

    The rows are counted in the written files, whose footers hold the number. An empty table is
    refused before anything is written.
    """
    if df.isEmpty():
        raise EmptyInput("the derived table has no rows")
    df.write.mode(mode).parquet(f"{path}/data")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data").count()
    lineage = {
        "type": kind, "sources": list(sources), "steps": list(steps),
        "rows_before": rows_before, "rows_after": written,
    }
    rows = [(kind, list(sources), list(steps), rows_before, written)]
    schema = "type string, sources array<string>, steps array<string>, rows_before long, rows_after long"
    df.sparkSession.createDataFrame(rows, schema).coalesce(1).write.mode(mode).json(f"{path}/lineage")
    return lineage


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """All tables of a report in long form, one partition per section."""
    for name, table in tables.items():
        long_form(name, table).drop("section").write.mode(mode).json(f"{path}/section={name}")


def log_query(
    result: DataFrame, question: str, plan: Plan, log_path: str, asked_at: datetime, preview_rows: int = 5
) -> None:
    """Append one row about an executed plan: question, plan, row count, columns, a sample of rows."""
    plan_json = json.dumps(plan, default=vars, ensure_ascii=False)
    shown = head_sample(result, preview_rows).agg(F.collect_list(F.to_json(F.struct(*map(col, result.columns)))).alias("s"))
    result.agg(F.count(F.lit(1)).alias("row_count")).withColumn("sample_rows", shown.scalar()).select(
        F.lit(asked_at).alias("asked_at"), F.lit(question).alias("question"), F.lit(plan_json).alias("plan"),
        "row_count", F.array(*map(F.lit, result.columns)).alias("columns"), "sample_rows",
    ).write.mode("append").json(log_path)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with rows of equal key replaced by the source's, and new rows added. A source key
    that occurs twice is an error when the rows are computed."""
    require_columns(target, keys, "key")
    require_columns(source, keys, "key")
    source = unique_keys(source, keys)
    kept = target.join(source.select(*map(col, keys)), list(keys), "left_anti")
    return kept.unionByName(source.select(*map(col, target.columns)))


def upsert_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many records an upsert inserts and updates."""
    held = target.select(*map(col, keys)).distinct().withColumn("__held", F.lit(True))
    return source.join(held, list(keys), "left").agg(
        F.coalesce(F.count_if(F.col("__held").isNull()), F.lit(0)).alias("inserted"),
        F.coalesce(F.count_if(F.col("__held").isNotNull()), F.lit(0)).alias("updated"),
    )
