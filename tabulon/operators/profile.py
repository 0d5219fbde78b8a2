"""What is in a table: missing cells, distinct values, ranges, common values, quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabulon.functions.rounding import half_up
from tabulon.functions.schema import (
    col, data_type, is_numeric, is_temporal, kind_of, require_columns,
)
from tabulon.session import computed_once

# How many common values are kept, and the shares that count as a problem.
TOP_VALUES = 5
ISSUE_SHARE = 0.05
LOW_COMPLETENESS = 0.95
HIGH_MISSING_PCT = 10
CATEGORY_VALUES = 200


def from_one_row(one_row: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """Turn a one-row table of aggregates into one row per struct."""
    return one_row.select(F.inline(F.array(*rows)))


def value_text(df: DataFrame, name: str) -> Column:
    """A value as text, with one spelling for zero."""
    if isinstance(data_type(df, name), (T.DoubleType, T.FloatType)):
        return (col(name) + F.lit(0.0)).cast("string")
    if isinstance(data_type(df, name), (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(col(name))
    return col(name).cast("string")


def compact_value(df: DataFrame, name: str) -> Column:
    """A value to compare by: a text stands as its SHA-256 hash, so texts are not shuffled."""
    if not isinstance(data_type(df, name), T.StringType):
        return col(name)
    return F.sha2(col(name), 256)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, unique): distinct values of all columns in one shuffle, null counted as one."""
    require_columns(df, columns)
    compact = df.select(*[compact_value(df, c).alias(c) for c in columns])
    return value_counts(compact, columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for all columns in one shuffle, counted before it."""
    require_columns(df, columns)
    cells = [F.struct(F.lit(c).alias("column"), value_text(df, c).alias("value")) for c in columns]
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int = TOP_VALUES) -> DataFrame:
    """The most common non-null values of each column."""
    return _best_values(value_counts(df, columns), k)


def _best_values(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most common values per column. Null ranks last and goes after the ranking: a
    filter before it would count the values a second time where the counts are used elsewhere."""
    best = Window.partitionBy("column").orderBy(F.col("value").isNull(), F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(best))
    return ranked.filter((F.col("rank") <= k) & F.col("value").isNotNull())


def most_common(counts: DataFrame, k: int | None = None) -> DataFrame:
    """Of (column, value, n): all values that reach the column's largest count, or ``k`` of them."""
    if k is not None:
        top = _best_values(counts, k).withColumn("most", F.max("n").over(Window.partitionBy("column")))
        return top.filter(F.col("n") == F.col("most")).select("column", "value", "n")
    # One row per column is looked up.
    most = counts.groupBy("column").agg(F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("n"))
    found = counts.join(F.broadcast(most), ["column", "n"]).select("column", "value", "n")
    return found.filter(F.col("value").isNotNull())


def modes(df: DataFrame, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """The values that are most common, all ties or ``k`` of them."""
    return most_common(value_counts(df, columns), k)


def distinct_values(df: DataFrame, column: str, search: str = "", limit: int | None = None) -> DataFrame:
    """Sorted distinct values, optionally only those a case-insensitive pattern finds, each with
    the number of distinct values and whether the list is cut."""
    require_columns(df, [column])
    found = df.filter(col(column).isNotNull()).select(col(column).alias("value"))
    if search:
        found = found.filter(F.col("value").cast("string").rlike("(?i)" + search))
    found = found.distinct()
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    shown = found.orderBy("value") if limit is None else found.orderBy("value").limit(limit)
    return shown.select(
        F.col("value").cast("string").alias("value"),
        total.alias("total_unique"),
        F.lit(False).alias("truncated") if limit is None else (total > limit).alias("truncated"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows and rows that repeat an earlier one."""
    whole = df.groupBy(*[compact_value(df, c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return whole.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    )


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows and null cells, from one pass."""
    columns = list(columns or df.columns)
    require_columns(df, columns)
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"present{i}") for i, c in enumerate(columns)],
    )
    return from_one_row(
        totals,
        [
            F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("column"), F.col("rows"),
                (F.col("rows") - F.col(f"present{i}")).alias("missing"),
            )
            for i, c in enumerate(columns)
        ],
    )


def quality(df: DataFrame) -> DataFrame:
    """One row: size, completeness and uniqueness of the table."""
    rows, cells = F.col("rows"), F.col("rows") * len(df.columns)
    repeated = duplicate_rows(df).select("duplicate_rows").scalar()
    complete = F.when(cells > 0, half_up(1 - F.col("missing") / cells, 4)).otherwise(1.0)
    unique = F.when(rows > 0, half_up(1 - F.col("duplicate_rows") / rows, 4)).otherwise(1.0)
    return (
        missing_counts(df)
        .agg(F.max("rows").alias("rows"), F.sum("missing").alias("missing"))
        .withColumn("duplicate_rows", repeated)
        .select(
            rows, F.lit(len(df.columns)).alias("columns"), "missing", "duplicate_rows",
            complete.alias("completeness"), unique.alias("uniqueness"),
        )
    )


def quality_issues(df: DataFrame, share: float = ISSUE_SHARE) -> DataFrame:
    """Columns in which a notable share of the cells is missing."""
    ratio = F.try_divide(F.col("missing"), F.col("rows"))
    return (
        missing_counts(df)
        .filter((F.col("missing") > 0) & (ratio >= share))
        .select("column", "missing", half_up(ratio, 4).alias("ratio"))
    )


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: kind, type, missing, distinct values (null counts as one) and range.

    ``exact=False`` estimates the distinct values in the first pass and saves the shuffle.
    """
    fields = df.schema.fields

    aggregates = [F.count(F.lit(1)).alias("rows")]
    ranged = [i for i, f in enumerate(fields) if is_numeric(f.dataType) or is_temporal(f.dataType)]
    for i, f in enumerate(fields):
        aggregates.append(F.count(col(f.name)).alias(f"present{i}"))
        if i in ranged:
            aggregates += [F.min(col(f.name)).alias(f"min{i}"), F.max(col(f.name)).alias(f"max{i}")]
        if is_numeric(f.dataType):
            aggregates.append(F.avg(col(f.name).cast("double")).alias(f"mean{i}"))
        if not exact:
            aggregates.append(F.approx_count_distinct(col(f.name)).alias(f"unique{i}"))

    def made(stem: str, i: int, held: bool, dtype: str) -> Column:
        return (F.col(f"{stem}{i}") if held else F.lit(None)).cast(dtype)

    rows = F.col("rows")
    structs = []
    for i, f in enumerate(fields):
        missing = rows - F.col(f"present{i}")
        guess = F.lit(None).cast("long") if exact else F.col(f"unique{i}") + F.when(missing > 0, 1).otherwise(0)
        structs.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                F.lit(kind_of(f.dataType)).alias("kind"), F.lit(f.dataType.simpleString()).alias("dtype"),
                missing.alias("missing"),
                F.when(rows > 0, half_up(100 * missing / rows, 2)).otherwise(0.0).alias("missing_pct"),
                guess.alias("unique"), made("min", i, i in ranged, "string").alias("min"),
                made("max", i, i in ranged, "string").alias("max"),
                made("mean", i, is_numeric(f.dataType), "double").alias("mean"),
            )
        )
    described = from_one_row(df.agg(*aggregates), structs)
    if not exact:
        return described
    distinct = distinct_counts(df, df.columns)
    return described.drop("unique").join(F.broadcast(distinct), "column", "left").select(
        "position", "column", "kind", "dtype", "missing", "missing_pct",
        F.coalesce("unique", F.lit(0)).cast("long").alias("unique"), "min", "max", "mean",
    )


def profile_insights(df: DataFrame) -> DataFrame:
    """The notable facts of a profile as (rule, column, value)."""
    described, whole = computed_once(profile(df)), computed_once(quality(df))
    rows, complete, repeated = F.col("rows"), F.col("completeness"), F.col("duplicate_rows")
    numbers = described.filter(F.col("kind") == "number").agg(F.count(F.lit(1)).alias("n"))
    categories = described.filter((F.col("kind") != "number") & (F.col("unique") <= CATEGORY_VALUES))
    dated = described.filter(F.col("kind") == "datetime").orderBy("position").limit(1)
    holes = described.filter(F.col("missing_pct") >= HIGH_MISSING_PCT)
    days = F.datediff(F.to_date("max"), F.to_date("min"))
    facts = [
        (whole.filter(rows > 0), "rows", None, rows),
        (whole.filter(complete < LOW_COMPLETENESS), "completeness", None, complete),
        (whole.filter(repeated > 0), "duplicate_rows", None, repeated),
        (categories.orderBy(F.desc("unique"), "position").limit(1), "category", "column", F.col("unique")),
        (numbers.filter("n > 0"), "numeric_columns", None, F.col("n")),
        (dated.filter(F.col("min").isNotNull()), "date_span_days", "column", days),
        (holes, "missing_pct", "column", F.col("missing_pct")),
    ]
    parts = [
        source.select(
            F.lit(place).alias("place"), F.lit(rule).alias("rule"),
            (F.lit(None).cast("string") if column is None else F.col(column)).alias("column"),
            value.cast("double").alias("value"),
        )
        for place, (source, rule, column, value) in enumerate(facts)
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.orderBy("place", "column").select("rule", "column", "value")
