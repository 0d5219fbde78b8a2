"""Fact tables of a report, and a compact summary of a table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabulon.errors import InvalidRequest
from tabulon.functions.rounding import half_up
from tabulon.functions.schema import (
    col, is_numeric, is_temporal, numeric_columns, require_columns, require_numeric,
)
from tabulon.functions.text import truncate_cell
from tabulon.operators.charts import histogram, scatter_points
from tabulon.operators.explore import grouped, sortable
from tabulon.operators.filters import apply_filters
from tabulon.operators.ordering import quartiles, row_numbers
from tabulon.operators.patterns import patterns
from tabulon.operators.profile import from_one_row, value_text
from tabulon.operators.stats import correlation_matrix, statistics, top_anomalies, top_correlations
from tabulon.plans.specs import AggSpec, FilterSpec
from tabulon.session import computed_once

# Report kinds, default sizes, shares that count as concentrated.
REPORT_KINDS = ("summary", "executive", "full")
REPORT_CONTAMINATION = 0.05
TOP_SHARE_OF, TOP_SHARE_PCT = 3, 50
SUMMARY_ROWS, SUMMARY_GROUPS, SUMMARY_MODES = 6, 12, 3


def group_facts(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Count, and sum, mean, least and largest value of each metric, per group."""
    require_columns(df, keys, "group_by column")
    made = [F.count(F.lit(1)).alias("count")]
    for m in metrics:
        made += [
            F.coalesce(F.sum(col(m)), F.lit(0)).alias(f"{m}__sum"), F.avg(col(m)).alias(f"{m}__mean"),
            F.min(col(m)).alias(f"{m}__min"), F.max(col(m)).alias(f"{m}__max"),
        ]
    return df.groupBy(*map(col, keys)).agg(*made)


def _by_size(keys: Sequence[str]) -> list:
    return [F.desc("count"), *[col(k).asc_nulls_last() for k in keys]]


def grouped_table(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], top_n: int = 10) -> DataFrame:
    """The largest groups by rows, twice ``top_n`` of them, with their share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return (
        group_facts(df, keys, metrics)
        .orderBy(*_by_size(keys))
        .limit(2 * top_n)
        .withColumn("share_pct", half_up(100.0 * F.col("count") / total, 2))
    )


def top_tables(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], top_n: int = 10) -> DataFrame:
    """Per metric the groups with the largest sum: (metric, rank, keys, count, sum, mean)."""
    groups = group_facts(df, keys, metrics)
    long = groups.select(
        *map(col, keys),
        "count",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        col(f"{m}__sum").cast("double").alias("sum"),
                        col(f"{m}__mean").cast("double").alias("mean"),
                    )
                    for m in metrics
                ]
            )
        ),
    )
    best = Window.partitionBy("metric").orderBy(F.desc("sum"), *[col(k).asc_nulls_last() for k in keys])
    return (
        long.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top_n)
        .select("metric", "rank", *map(col, keys), "count", "sum", "mean")
    )


def _label(keys: Sequence[str]):
    return F.concat_ws(" / ", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys])


def leaders(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(fact, label, value, share): the largest group, a dominating top three, and the leader of
    each metric."""
    top = grouped_table(df, keys, [], 3).orderBy(*_by_size(keys)).limit(TOP_SHARE_OF)
    # Three rows at most reach this window.
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*_by_size(keys))))
    first = F.col("rank") == 1
    facts = ranked.agg(
        F.count(F.lit(1)).alias("groups"),
        F.max(F.when(first, _label(keys))).alias("label"),
        F.max(F.when(first, F.col("count"))).cast("double").alias("most"),
        F.max(F.when(first, F.col("share_pct"))).alias("most_share"),
        F.sum("count").cast("double").alias("three"),
        half_up(F.sum("share_pct"), 1).alias("three_share"),
    ).filter("groups > 0")
    out = from_one_row(
        facts,
        [
            F.struct(
                F.lit("largest_group").alias("fact"), "label", F.col("most").alias("value"),
                F.col("most_share").alias("share"),
            ),
            F.struct(
                F.lit("top_three_share").alias("fact"), F.lit("").alias("label"), F.col("three").alias("value"),
                F.col("three_share").alias("share"),
            ),
        ],
    ).filter((F.col("fact") == "largest_group") | (F.col("share") >= TOP_SHARE_PCT))
    if metrics:
        best = top_tables(df, keys, metrics, 3).filter(F.col("rank") == 1).select(
            F.concat(F.lit("top_"), "metric").alias("fact"), _label(keys).alias("label"),
            F.col("sum").alias("value"), F.lit(None).cast("double").alias("share"),
        )
        out = out.unionByName(best)
    return out


def default_group(df: DataFrame) -> str | None:
    """The first column that holds categories, else the first column."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BooleanType)) or is_temporal(f.dataType):
            return f.name
    return df.columns[0] if df.columns else None


def describe_filters(filters: Iterable[FilterSpec | dict]) -> str:
    parts = []
    for spec in map(FilterSpec.of, filters):
        shown = "" if spec.op in ("is_null", "not_null") or spec.value is None else f" {spec.value}"
        parts.append(f"{spec.column} {spec.op}{shown}")
    return "; ".join(parts)


def build_report(
    df: DataFrame,
    kind: str = "summary",
    group_by: Sequence[str] = (),
    metrics: Sequence[str] = (),
    top_n: int = 10,
    filters: Iterable[FilterSpec | dict] = (),
    order_by: Sequence[str] = (),
    scatter: int | None = None,
) -> dict[str, DataFrame]:
    """The tables of a report by name; ``scatter`` points are sampled by ``order_by``, or all shown. They share one filtered input; persist it beforehand when
    it is read from a slow source, and write the tables with ``sources.writers.write_tables``."""
    if kind not in REPORT_KINDS:
        raise InvalidRequest(f"report kind must be one of {', '.join(REPORT_KINDS)}")
    filters = [f for f in map(FilterSpec.of, filters) if f.column]
    work = apply_filters(df, filters)
    keys = list(group_by) or [k for k in [default_group(work)] if k]
    require_columns(work, keys, "group_by column")
    names = [m for m in metrics if m not in keys]
    if not metrics:
        names = [c for c in numeric_columns(work) if c not in keys]
    elif names:
        names = require_numeric(work, names)
    n = F.count(F.lit(1)).cast("string").alias("n")
    facts = [
        ("columns", str(len(df.columns))), ("report", kind), ("filters", describe_filters(filters)),
        ("group_by", ", ".join(keys)), ("metrics", ", ".join(names)), ("top_n", str(top_n)),
    ]
    counted = df.agg(n).select(F.lit("source_rows").alias("fact"), F.col("n").alias("value")).union(
        work.agg(n).select(F.lit("filtered_rows"), F.col("n"))
    )
    quarters = quartiles(work, numeric_columns(work))
    middle = {c: values[1] for c, values in quarters.items()}
    tables = {
        "overview": df.sparkSession.createDataFrame(facts, "fact string, value string").union(counted),
        "statistics": statistics(work, quarters=quarters).drop("most_common"),
        "groups": grouped_table(work, keys, names, top_n),
        "leaders": leaders(work, keys, names),
        "patterns": patterns(work, keys[0] if keys else None, names or None, middle=middle),
    }
    if names:
        tables["top_groups"] = top_tables(work, keys, names, top_n)
        tables["histogram"] = histogram(work, names[0])
    if len(names) >= 2:
        tables["scatter"] = scatter_points(work, names[0], names[1], scatter, order_by)
    if kind in ("executive", "full"):
        tables["correlations"] = correlation_matrix(work)
    if kind == "full" and names:
        tables["anomalies"] = top_anomalies(work, names, REPORT_CONTAMINATION)
    return tables


def long_form(name: str, table: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """A report table as (section, row, column, value) text; some have as many rows as there are points to show."""
    numbered = row_numbers(table, list(order or sortable(table)), "__row")
    cells = [
        F.struct(F.lit(c).alias("column"), value_text(table, c).alias("value")) for c in table.columns
    ]
    return numbered.select(F.lit(name).alias("section"), F.col("__row").alias("row"), F.inline(F.array(*cells)))


def context_summary(
    df: DataFrame,
    group_by: Sequence[str] = (),
    aggregations: Sequence[AggSpec | dict] = (),
    order_by: Sequence[str] = (),
    filters: Iterable[FilterSpec | dict] = (),
) -> DataFrame:
    """(section, item, payload): statistics of every column, a few sample rows, the first groups
    and the strongest correlations as JSON, all taken over all rows."""
    work = apply_filters(df, filters)
    described = computed_once(statistics(work, modes_kept=SUMMARY_MODES))
    parts = [
        described.select(
            F.lit("column_stats").alias("section"), F.col("column").alias("item"),
            F.to_json(F.struct(*[c for c in described.columns if c not in ("position", "column")])).alias("payload"),
        )
    ]
    order = [col(c).asc_nulls_last() for c in (order_by or sortable(work))]
    sample = work.orderBy(*order).limit(SUMMARY_ROWS)
    shown = sample.select(*[truncate_cell(value_text(work, c)).alias(c) for c in work.columns])
    parts.append(shown.select(F.lit("sample_row"), F.lit(""), F.to_json(F.struct(*map(col, shown.columns)))))
    if group_by:
        groups = grouped(work, group_by, aggregations)
        head = groups.orderBy(*[col(c).asc_nulls_last() for c in group_by]).limit(SUMMARY_GROUPS)
        parts.append(head.select(F.lit("group"), _label(group_by), F.to_json(F.struct(*map(col, groups.columns)))))
    if len([f for f in df.schema.fields if is_numeric(f.dataType)]) > 1:
        best = top_correlations(work)
        parts.append(best.select(F.lit("correlation"), F.concat("a", F.lit(" ~ "), "b"), F.to_json(F.struct("corr"))))
    parts.append(
        described.filter((F.col("count") > 0) & (F.col("missing") / F.col("count") >= 0.1))
        .select(F.lit("insight"), "column", F.to_json(F.struct(half_up(100 * F.col("missing") / F.col("count"), 1).alias("missing_pct"))))
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
