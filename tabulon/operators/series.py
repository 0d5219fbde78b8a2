"""Time series, period comparison, forecasts, Pareto ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.errors import InvalidRequest
from tabulon.functions.rounding import half_up
from tabulon.functions.schema import col, numeric_columns, require_columns, require_numeric
from tabulon.functions.temporal import as_datetime, in_period, parse_boundary, period_start
from tabulon.operators.explore import aggregate_column
from tabulon.operators.profile import from_one_row
from tabulon.session import computed_once

# Aggregates on offer, rows in the recent mean, row limits.
SERIES_AGGREGATES = ("sum", "mean", "min", "max", "count")
PARETO_AGGREGATES = ("sum", "mean", "count")
RECENT_ROWS = 7
PARETO_MARK = 80


def change_pct(now: Column, before: Column) -> Column:
    """Change in percent; null without a value before, or a zero one."""
    return half_up(100.0 * F.try_divide(now - before, F.nullif(before, F.lit(0))), 2)


def timeseries(
    df: DataFrame,
    date_column: str,
    metrics: Sequence[str],
    granularity: str = "day",
    agg: str = "sum",
    limit: int | None = None,
) -> DataFrame:
    """Aggregates per day, Monday week or month, the earliest first, with the change in percent
    from one period to the next: all periods, or the first ``limit`` of them."""
    if agg not in SERIES_AGGREGATES:
        raise InvalidRequest(f"agg must be one of {', '.join(SERIES_AGGREGATES)}")
    names = require_numeric(df, metrics)
    period = period_start(as_datetime(df, date_column), granularity)
    grouped = (
        df.groupBy(period.alias("period"))
        .agg(*[aggregate_column(m, agg).alias(m) for m in names])
        .filter(F.col("period").isNotNull())
    )
    if limit is not None:
        grouped = grouped.orderBy("period").limit(limit)
    # One row per period reaches this window.
    order = Window.orderBy("period")
    return grouped.select(
        F.date_format("period", "yyyy-MM-dd").alias("period"),
        *map(col, names),
        *[change_pct(col(m), F.lag(col(m)).over(order)).alias(f"{m}__delta_pct") for m in names],
    )


def compare_periods(
    df: DataFrame,
    date_column: str,
    period_a: tuple[object, object],
    period_b: tuple[object, object],
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Sum, mean and count of each metric in two periods, from one pass. A period without rows
    is an error when the result is computed."""
    require_columns(df, [date_column])
    names = require_numeric(df, metrics or [c for c in numeric_columns(df) if c != date_column])
    in_a, in_b = in_period(df, date_column, *period_a), in_period(df, date_column, *period_b)
    aggregates = [F.count_if(in_a).alias("rows_a"), F.count_if(in_b).alias("rows_b")]
    for i, m in enumerate(names):
        for side, inside in (("a", in_a), ("b", in_b)):
            value = F.when(inside, col(m).cast("double"))
            aggregates += [
                half_up(F.coalesce(F.sum(value), F.lit(0.0)), 4).alias(f"sum_{side}{i}"),
                half_up(F.coalesce(F.avg(value), F.lit(0.0)), 4).alias(f"mean_{side}{i}"),
                F.count(value).cast("double").alias(f"count_{side}{i}"),
            ]
    structs = []
    for i, m in enumerate(names):
        for stat in ("sum", "mean", "count"):
            a, b = F.col(f"{stat}_a{i}"), F.col(f"{stat}_b{i}")
            pct = F.lit(None).cast("double") if stat == "count" else change_pct(b, a)
            structs.append(
                F.struct(
                    F.lit(m).alias("column"), F.lit(stat).alias("stat"), a.alias("period_a"),
                    b.alias("period_b"), half_up(b - a, 4).alias("delta"), pct.alias("delta_pct"),
                )
            )
    # Both periods lie between the outer bounds, so other rows need not be read.
    first = min(parse_boundary(p[0]) for p in (period_a, period_b))
    last = max(parse_boundary(p[1], end_of_day=True) for p in (period_a, period_b))
    one = df.filter(in_period(df, date_column, first, last)).agg(*aggregates)
    empty = (F.col("rows_a") == 0) | (F.col("rows_b") == 0)
    checked = one.withColumn(
        "rows_a", F.when(empty, F.raise_error(F.lit("a period has no rows")).cast("long")).otherwise(F.col("rows_a"))
    )
    return from_one_row(checked.filter(F.col("rows_a") > 0), structs)


def _forecast_rows(facts: DataFrame, keys: Sequence[str], periods: int) -> DataFrame:
    drift = (F.col("last") - F.col("first")) / (F.col("n") - 1)
    return facts.select(
        *map(col, keys), "last_date", "recent", "mean", drift.alias("drift"),
        F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"),
    ).select(
        *map(col, keys),
        "last_date",
        "step",
        half_up(F.col("recent") + F.col("drift") * F.col("step"), 4).alias("yhat"),
        half_up(F.col("mean"), 4).alias("baseline_mean"),
    )


def _facts(when: Column, target: Column) -> list[Column]:
    place = F.struct(when, target)
    return [
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"),
        F.min_by(target, place).alias("first"), F.max_by(target, place).alias("last"),
        F.max(when).alias("last_date"),
    ]


def forecast(df: DataFrame, date_column: str, target: str, periods: int = 30) -> DataFrame:
    """The mean of the last seven rows plus the average step from first to last row."""
    require_columns(df, [date_column])
    require_numeric(df, [target])
    work = df.select(col(date_column).alias("when"), col(target).cast("double").alias("target")).filter(
        F.col("when").isNotNull() & F.col("target").isNotNull()
    )
    recent = (
        work.orderBy(F.desc("when"), F.desc("target")).limit(RECENT_ROWS).agg(F.avg("target").alias("r")).scalar()
    )
    facts = work.agg(*_facts(F.col("when"), F.col("target"))).withColumn("recent", recent)
    short = F.raise_error(F.lit("a forecast needs two rows")).cast("long")
    checked = facts.withColumn("n", F.when(F.col("n") < 2, short).otherwise(F.col("n"))).filter(F.col("n") > 1)
    return _forecast_rows(checked, [], periods)


def forecast_by_key(
    df: DataFrame, keys: Sequence[str], date_column: str, target: str, periods: int = 30
) -> DataFrame:
    """The same forecast for every series; a series with one row has none."""
    require_columns(df, [date_column, *keys])
    require_numeric(df, [target])
    work = df.select(
        *map(col, keys), col(date_column).alias("when"), col(target).cast("double").alias("target")
    ).filter(F.col("when").isNotNull() & F.col("target").isNotNull())
    latest = Window.partitionBy(*map(col, keys)).orderBy(F.desc("when"), F.desc("target"))
    recent = (
        work.withColumn("rn", F.row_number().over(latest))
        .filter(F.col("rn") <= RECENT_ROWS)
        .groupBy(*[col(k).alias(f"__{k}") for k in keys])
        .agg(F.avg("target").alias("recent"))
    )
    facts = work.groupBy(*map(col, keys)).agg(*_facts(F.col("when"), F.col("target"))).filter(F.col("n") > 1)
    same = F.lit(True)
    for k in keys:
        same = same & col(k).eqNullSafe(F.col(f"__{k}"))
    return _forecast_rows(facts.join(recent, same), keys, periods)


def pareto_groups(df: DataFrame, keys: Sequence[str], metric: str, agg: str = "sum") -> DataFrame:
    """The value of every group; rows without the metric count only for ``count``."""
    if agg not in PARETO_AGGREGATES:
        raise InvalidRequest(f"agg must be one of {', '.join(PARETO_AGGREGATES)}")
    if not keys:
        raise InvalidRequest("group_by needs at least one column")
    require_columns(df, [*keys, metric])
    if agg == "count":
        return df.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).cast("double").alias("value"))
    made = F.sum(col(metric)) if agg == "sum" else F.avg(col(metric))
    return df.filter(col(metric).isNotNull()).groupBy(*map(col, keys)).agg(made.cast("double").alias("value"))


def pareto(df: DataFrame, keys: Sequence[str], metric: str, agg: str = "sum", top_n: int = 20) -> DataFrame:
    """The largest groups with their share and the share reached so far, in percent."""
    groups = pareto_groups(df, keys, metric, agg)
    total = groups.agg(F.sum("value").alias("t")).scalar()
    ranked = (
        groups.orderBy(F.desc("value"), *[col(k).asc_nulls_last() for k in keys])
        .limit(top_n)
        .withColumn("share", F.coalesce(F.try_divide(100.0 * F.col("value"), F.nullif(total, F.lit(0))), F.lit(0.0)))
    )
    # The listed rows reach this window.
    order = Window.orderBy(F.desc("value"), *[col(k).asc_nulls_last() for k in keys])
    return ranked.select(
        *map(col, keys),
        F.col("value"),
        F.row_number().over(order).alias("rank"),
        half_up(F.col("share"), 2).alias("share_pct"),
        half_up(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("cum_share_pct"),
    )


def _groups_to_mark(groups: DataFrame, keys: Sequence[str]) -> Column:
    """How many of the largest groups reach the mark. All groups are sorted by ranges; each range is
    summed by itself and starts from the sums of the ranges before it."""
    down = [F.desc("value"), *[col(k).asc_nulls_last() for k in keys]]
    ranged = computed_once(groups.repartitionByRange(*down).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*down)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("value").alias("sum"), F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("sum_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
    )
    total = F.nullif(groups.agg(F.sum("value").alias("t")).scalar(), F.lit(0))
    reached = F.col("sum_before") + F.sum("value").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(F.broadcast(parts), "part").select(
        (F.col("n_before") + F.row_number().over(inside)).alias("rank"),
        half_up(F.try_divide(100.0 * reached, total), 2).alias("share"),
    )
    return placed.filter(F.col("share") >= PARETO_MARK).agg(F.min("rank").alias("r")).scalar()


def pareto_summary(df: DataFrame, keys: Sequence[str], metric: str, agg: str = "sum") -> DataFrame:
    """One row: groups, total, concentration index, and how many of the largest groups reach 80 %
    (null where the total is 0)."""
    groups = pareto_groups(df, keys, metric, agg)
    squares = F.sum(F.col("value") * F.col("value"))
    total = F.coalesce(F.sum("value"), F.lit(0.0))
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        total.alias("total"),
        F.when(total > 0, half_up(squares / (total * total), 4)).otherwise(0.0).alias("hhi"),
    ).withColumn("groups_to_80", _groups_to_mark(groups, keys).cast("long"))


def concentration(df: DataFrame, key: str) -> DataFrame:
    """The concentration index of row counts over the groups of one column."""
    return pareto_summary(df, [key], key, "count").select("groups", "hhi")
