"""The universal query: filter, group or select, sort, page; and what a page says about itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.errors import InvalidRequest
from tabulon.functions.schema import col, data_type, is_numeric, require_columns
from tabulon.operators.filters import all_filters, apply_filters, plan_predicate
from tabulon.operators.samples import sortable
from tabulon.plans.specs import AGGREGATES, AggSpec, Plan, QuerySpec

# Names that mean "all rows", and the size at which a grouping is called large.
ALL_ROWS = ("*", "_all_")
LARGE_GROUPING = 10_000


def aggregate_column(name: str, agg: str) -> Column:
    """An aggregate with the spec's null rules: an empty sum is 0, null is one distinct value."""
    c = col(name)
    match agg:
        case "sum":
            return F.coalesce(F.sum(c), F.lit(0))
        case "mean":
            return F.avg(c)
        case "min":
            return F.min(c)
        case "max":
            return F.max(c)
        case "count":
            return F.count(c)
        case "n_unique":
            return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))
    raise InvalidRequest(f"unsupported aggregation: {agg}")


def spec_aggregate(df: DataFrame, spec: AggSpec | dict) -> Column:
    spec = AggSpec.of(spec)
    alias = spec.alias or f"{spec.column}__{spec.agg}"
    if spec.agg not in AGGREGATES:
        raise InvalidRequest(f"unsupported aggregation: {spec.agg}")
    if spec.agg == "count" and spec.column in ALL_ROWS:
        return F.count(F.lit(1)).alias(alias)
    require_columns(df, [spec.column], "aggregation column")
    if spec.agg not in ("count", "n_unique") and not is_numeric(data_type(df, spec.column)):
        raise InvalidRequest(f"column '{spec.column}' is not numeric, '{spec.agg}' needs numbers")
    return aggregate_column(spec.column, spec.agg).alias(alias)


def grouped(
    df: DataFrame, keys: Sequence[str], aggregations: Sequence[AggSpec | dict] | None = None
) -> DataFrame:
    """Group by the keys; without aggregations each group is counted."""
    if not keys:
        raise InvalidRequest("group_by needs at least one column")
    require_columns(df, keys, "group_by column")
    wanted = [spec_aggregate(df, s) for s in map(AggSpec.of, aggregations or []) if s.column]
    return df.groupBy(*map(col, keys)).agg(*(wanted or [F.count(F.lit(1)).alias("count")]))


def select_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    wanted = [c for c in columns or [] if c]
    if not wanted:
        return df
    require_columns(df, wanted)
    return df.select(*map(col, wanted))


def sort_rows(
    df: DataFrame,
    by: str | None,
    direction: str = "asc",
    nulls_last: bool = True,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Sort by one column; an unknown column leaves the rows as they are."""
    if not by or by not in df.columns:
        return df
    c, down = col(by), (direction or "asc").lower() == "desc"
    if nulls_last:
        first = c.desc_nulls_last() if down else c.asc_nulls_last()
    else:
        first = c.desc_nulls_first() if down else c.asc_nulls_first()
    return df.orderBy(first, *[col(t).asc_nulls_last() for t in ties if t != by])


def page(df: DataFrame, offset: int, limit: int, order: Sequence[Column]) -> DataFrame:
    """One page of a totally ordered table."""
    if not order:
        raise InvalidRequest("a page needs an order")
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


def result_rows(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """Filters and grouping or column choice, before sort and paging."""
    kept = apply_filters(df, spec.filters)
    if spec.mode == "grouped":
        return grouped(kept, spec.group_by, spec.aggregations)
    return select_columns(kept, spec.columns)


def run_query(df: DataFrame, spec: QuerySpec, max_limit: int | None = None) -> DataFrame:
    """Run a query specification; ties in the sort are settled by the other columns.

    A limit is honoured as it is; an entry point with a largest page refuses larger ones.
    """
    limit = spec.limit
    if limit is not None and (limit < 0 or max_limit is not None and limit > max_limit):
        raise InvalidRequest(f"limit {limit} is out of range" + ("" if max_limit is None else f", at most {max_limit}"))
    out = result_rows(df, spec)
    paged = limit is not None or spec.offset > 0
    if spec.sort_by in out.columns:
        out = sort_rows(out, spec.sort_by, spec.sort_dir, ties=sortable(out) if paged else ())
    elif paged and (spec.offset > 0 or spec.mode == "grouped"):
        out = out.orderBy(*[col(c).asc_nulls_last() for c in sortable(out)])
    if spec.offset > 0:
        out = out.offset(spec.offset)
    return out if limit is None else out.limit(limit)


def run_plan(df: DataFrame, plan: Plan | dict | str) -> DataFrame:
    """Filters, then group or columns, then sort with nulls first, then the plan's limit."""
    plan = Plan.of(plan)
    work = df
    for spec in plan.filters:
        work = work.filter(plan_predicate(df, spec))
    if plan.group_by or plan.aggregations:
        require_columns(df, plan.group_by, "group_by column")
        require_columns(df, [a.column for a in plan.aggregations], "aggregation column")
        wanted = [
            aggregate_column(a.column, a.agg).alias(a.alias or f"{a.agg}_{a.column}")
            for a in plan.aggregations
        ] or [F.count(F.lit(1)).alias("count")]
        work = work.groupBy(*map(col, plan.group_by)).agg(*wanted)
    else:
        work = select_columns(work, plan.columns)
    work = sort_rows(work, plan.sort_by, plan.sort_dir, nulls_last=False, ties=sortable(work))
    return work.limit(plan.limit)


def query_counts(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """One row: rows of the source, rows the filters keep, and rows of the unpaged result.

    Counted by aggregates, which stay right when lost tasks run again; observed metrics may not.
    """
    counted = df.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.coalesce(F.count_if(all_filters(df, spec.filters)), F.lit(0)).alias("filtered_rows"),
    )
    if spec.mode == "raw":
        return counted.withColumn("total_rows", F.col("filtered_rows"))
    total = result_rows(df, spec).agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.withColumn("total_rows", total)


def result_limits(result: DataFrame, mode: str, limit: int, warn_at: int = LARGE_GROUPING) -> DataFrame:
    """One row: total and returned rows, whether rows are cut off, whether the grouping is large."""
    total = F.col("total_rows")
    large = (total >= warn_at) if mode == "grouped" else F.lit(False)
    return result.agg(F.count(F.lit(1)).alias("total_rows")).select(
        total,
        F.least(total, F.lit(limit)).cast("long").alias("returned_rows"),
        (total > limit).alias("truncated"),
        large.alias("large_grouping"),
    )


def resolve_column(df: DataFrame, name: str) -> str | None:
    """The column itself, or the first aggregate made of it (``name__sum`` and the like)."""
    if name in df.columns:
        return name
    return next((c for c in df.columns if c.startswith(f"{name}__")), None)


def chart_series(
    result: DataFrame, label: str, value: str, order: Sequence[Column], top_n: int = 30
) -> DataFrame:
    """Label and value pairs of the first rows; a missing value counts as 0."""
    label_column, value_column = resolve_column(result, label), resolve_column(result, value)
    if value_column is None:
        value_column = next((c for c in result.columns if "__" in c and c != label_column), None)
    shown = F.lit("") if label_column is None else F.coalesce(col(label_column).cast("string"), F.lit(""))
    number = F.lit(None) if value_column is None else col(value_column).try_cast("double")
    return (
        result.orderBy(*order)
        .limit(top_n)
        .select(shown.alias("label"), F.coalesce(number, F.lit(0.0)).alias("value"))
    )
