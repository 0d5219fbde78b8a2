"""Missing values, duplicates, text normalisation, outliers, and what a cleaning changed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.errors import InvalidRequest
from tabulon.functions.schema import (
    col, data_type, is_numeric, numeric_columns, require_columns, string_columns,
)
from tabulon.functions.temporal import time_literal
from tabulon.functions.text import normalize
from tabulon.operators.ordering import forward_fill, medians, quantiles
from tabulon.operators.profile import value_text

# Strategy names with their short forms, the fence factor, the text for unknown.
STRATEGIES = {
    "drop": "drop", "fill": "fill", "fill_zero": "fill_zero", "zero": "fill_zero",
    "fill_mean": "fill_mean", "mean": "fill_mean", "fill_median": "fill_median",
    "median": "fill_median", "fill_unknown": "fill_unknown", "unknown": "fill_unknown",
    "forward_fill": "forward_fill", "ffill": "forward_fill",
}
FENCE = 1.5
UNKNOWN = "Unknown"
FILLED_NUMBERS = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.withColumns(changed) if changed else df


def _fillable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, FILLED_NUMBERS)]


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without any null; NaN is a value and stays."""
    condition = F.lit(True)
    for c in df.columns:
        condition = condition & col(c).isNotNull()
    return df.filter(condition)


def fill_constant(df: DataFrame, value: Any) -> DataFrame:
    """Nulls of the columns whose type fits the value become the value."""
    changed: dict[str, Column] = {}
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(value, bool):
            if isinstance(f.dataType, T.BooleanType):
                changed[f.name] = F.coalesce(c, F.lit(value))
        elif isinstance(value, (int, float)):
            if is_numeric(f.dataType):
                typed = F.lit(value) if isinstance(value, float) else F.lit(value).cast(f.dataType)
                changed[f.name] = F.coalesce(c, typed)
        elif isinstance(value, str):
            if isinstance(f.dataType, T.StringType):
                changed[f.name] = F.coalesce(c, F.lit(value))
        elif isinstance(value, datetime) and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            changed[f.name] = F.coalesce(c, time_literal(value, f.dataType))
    return _replace(df, changed)


def fill_by_type(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Text becomes empty, numbers 0, instants ``as_of`` when one is given."""
    changed: dict[str, Column] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            changed[f.name] = F.coalesce(col(f.name), F.lit(""))
        elif isinstance(f.dataType, (T.LongType, T.DoubleType)):
            changed[f.name] = F.coalesce(col(f.name), F.lit(0).cast(f.dataType))
        elif as_of and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            changed[f.name] = F.coalesce(col(f.name), time_literal(as_of, f.dataType))
    return _replace(df, changed)


def fill_zero(df: DataFrame) -> DataFrame:
    return _replace(df, {c: F.coalesce(col(c), F.lit(0).cast(data_type(df, c))) for c in _fillable(df)})


def fill_mean(df: DataFrame) -> DataFrame:
    """Numbers get their column's mean; whole numbers become doubles."""
    names = _fillable(df)
    if not names:
        return df
    means = df.agg(F.struct(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)]).alias("m")).scalar()
    return _replace(
        df, {c: F.coalesce(col(c).cast("double"), means.getField(f"m{i}")) for i, c in enumerate(names)}
    )


def fill_median(df: DataFrame) -> DataFrame:
    """Numbers get their column's interpolated median; whole numbers become doubles."""
    names = _fillable(df)
    middle = medians(df, names)
    return _replace(
        df, {c: F.coalesce(col(c).cast("double"), F.lit(middle[c]).cast("double")) for c in names}
    )


def fill_unknown(df: DataFrame) -> DataFrame:
    changed: dict[str, Column] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            changed[f.name] = F.coalesce(col(f.name), F.lit(UNKNOWN))
        elif isinstance(f.dataType, FILLED_NUMBERS):
            changed[f.name] = F.coalesce(col(f.name), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.BooleanType):
            changed[f.name] = F.coalesce(col(f.name), F.lit(False))
    return _replace(df, changed)


def clean_missing(
    df: DataFrame,
    strategy: str = "drop",
    fill_value: Any = None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    as_of: datetime | None = None,
) -> DataFrame:
    """Treat missing cells by the named strategy."""
    name = STRATEGIES.get((strategy or "drop").lower())
    if name is None:
        raise InvalidRequest(f"unknown strategy '{strategy}'")
    if name == "forward_fill":
        return forward_fill(df, order_by, partition_by)
    if name == "fill":
        return fill_by_type(df, as_of) if fill_value is None else fill_constant(df, fill_value)
    simple = {
        "drop": drop_missing, "fill_zero": fill_zero, "fill_mean": fill_mean,
        "fill_median": fill_median, "fill_unknown": fill_unknown,
    }
    return simple[name](df)


def remove_duplicates(
    df: DataFrame, subset: Sequence[str] = (), order_by: Sequence[str] = ()
) -> DataFrame:
    """Distinct rows, or one row per key: the first in the given order, or any.

    The kept row is found by an aggregate, which merges a heavy key before the shuffle.
    """
    if not subset:
        return df.distinct()
    require_columns(df, [*subset, *order_by])
    if not order_by:
        return df.dropDuplicates(list(subset))
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.distinct()
    ordered = [c for c in df.columns if "map<" not in data_type(df, c).simpleString()]
    place = F.struct(*[col(c) for c in [*order_by, *[c for c in ordered if c not in order_by]]])
    kept = df.groupBy(*map(col, subset)).agg(F.min_by(F.struct(*map(col, rest)), place).alias("__kept"))
    return kept.select(*[col(c) if c in subset else F.col("__kept").getField(c).alias(c) for c in df.columns])


def normalize_strings(df: DataFrame) -> DataFrame:
    """All text columns stripped, with single blanks and in lower case."""
    return _replace(df, {c: normalize(col(c)) for c in string_columns(df)})


def iqr_fences(df: DataFrame, columns: Sequence[str], factor: float = FENCE, exact: bool = True) -> dict[str, tuple]:
    found = quantiles(df, {c: (0.25, 0.75) for c in columns}, exact)
    fences = {}
    for c, (q1, q3) in found.items():
        if q1 is not None:
            q1, q3 = float(q1), float(q3)
            fences[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return fences


def remove_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    factor: float = FENCE,
    joint: bool = False,
    exact: bool = True,
) -> DataFrame:
    """Keep rows inside the quartile fences; nulls fall out.

    Column after column, each fence is taken from the rows the earlier ones left; with
    ``joint`` all fences come from the whole input in one go.
    """
    columns = list(columns or numeric_columns(df))
    require_columns(df, columns)
    for group in ([columns] if joint else [[c] for c in columns]):
        for c, (low, high) in iqr_fences(df, group, factor, exact).items():
            df = df.filter((col(c) >= F.lit(low)) & (col(c) <= F.lit(high)))
    return df


@dataclass
class CleaningPlan:
    """Which steps run, in this order: missing, duplicates, text, outliers."""

    missing: str | None = "drop"
    duplicates: bool = True
    strings: bool = True
    outliers: bool = False
    order_by: Sequence[str] = field(default_factory=tuple)
    as_of: datetime | None = None


def clean_table(df: DataFrame, plan: CleaningPlan = CleaningPlan()) -> tuple[DataFrame, list[str]]:
    """The cleaned table and the names of the steps taken; an unknown strategy drops rows."""
    steps = []
    if plan.missing:
        name = plan.missing.lower() if plan.missing.lower() in STRATEGIES else "drop"
        df = clean_missing(df, name, order_by=plan.order_by, as_of=plan.as_of)
        steps.append(f"clean_missing:{name}")
    if plan.duplicates:
        df = remove_duplicates(df)
        steps.append("remove_duplicates")
    if plan.strings:
        df = normalize_strings(df)
        steps.append("normalize_strings")
    if plan.outliers and numeric_columns(df):
        df = remove_outliers(df)
        steps.append("remove_outliers")
    return df, steps


def cell_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed cells of rows both tables have, found by row key: (keys, column, before, after)."""
    require_columns(before, keys)
    require_columns(after, keys)
    shared = [c for c in before.columns if c in after.columns and c not in keys]
    old = before.select(*map(col, keys), F.struct(*[value_text(before, c).alias(c) for c in shared]).alias("__old"))
    new = after.select(*map(col, keys), F.struct(*[value_text(after, c).alias(c) for c in shared]).alias("__new"))
    both = old.join(new, list(keys))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("__old").getField(c).alias("before"),
                F.col("__new").getField(c).alias("after"),
            )
            for c in shared
        ]
    )
    changed = F.filter(cells, lambda cell: ~cell["before"].eqNullSafe(cell["after"]))
    return both.select(*map(col, keys), F.inline(changed))


def row_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, rows after, rows removed."""
    n = F.count(F.lit(1)).alias("n")
    left = after.agg(n).scalar()
    return before.agg(n).select(
        F.col("n").alias("rows_before"),
        left.alias("rows_after"),
        F.greatest(F.col("n") - left, F.lit(0)).alias("rows_removed"),
    )
