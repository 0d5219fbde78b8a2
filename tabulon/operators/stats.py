"""Descriptive statistics, correlations, z-score anomalies, KPIs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.errors import InvalidRequest
from tabulon.functions.rounding import half_up
from tabulon.functions.schema import (
    col, data_type, is_numeric, numeric_columns, require_columns, require_numeric,
)
from tabulon.operators.ordering import (
    Target, order_statistics, quantiles, quartile_targets, quartiles, sketches, with_average_ranks,
)
from tabulon.operators.profile import from_one_row, most_common, value_counts

PAIRS_PER_PASS = 300


# --- descriptive ------------------------------------------------------------------------


def statistics(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    modes_kept: int | None = 5,
    exact: bool = True,
    quarters: dict[str, tuple] | None = None,
) -> DataFrame:
    """One row per column. Numbers: mean, median, deviation, range, quartiles; text: distinct
    values and modes; the rest: distinct values. Quartiles that are known need not be found again."""
    columns = list(columns or df.columns)
    require_columns(df, columns)
    numbers = [c for c in columns if is_numeric(data_type(df, c))]
    others = [c for c in columns if c not in numbers]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggregates.append(F.count(col(c)).alias(f"present{i}"))
        if c in numbers:
            number = col(c).cast("double")
            aggregates += [
                F.avg(number).alias(f"mean{i}"), F.stddev_samp(number).alias(f"std{i}"),
                F.min(number).alias(f"min{i}"), F.max(number).alias(f"max{i}"),
            ]
    one_row = df.agg(*aggregates)
    if quarters is not None or not numbers:
        quarters = quarters or {}
    elif exact:
        # The moments are taken in the pass that brackets the quartiles.
        first = sketches(df, quartile_targets(numbers), aggregates)
        one_row = df.sparkSession.createDataFrame([tuple(first[c] for c in one_row.columns)], one_row.schema)
        quarters = quartiles(df, numbers, first)
    else:
        quarters = quantiles(df, {c: (0.25, 0.5, 0.75) for c in numbers}, exact=False)
    nothing = F.lit(None).cast("double")
    structs = []
    for i, c in enumerate(columns):
        number = c in numbers
        q25, middle, q75 = quarters.get(c, (None, None, None))
        structs.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("column"),
                F.lit(data_type(df, c).simpleString()).alias("dtype"),
                F.col("rows").alias("count"), (F.col("rows") - F.col(f"present{i}")).alias("missing"),
                (F.col(f"mean{i}") if number else nothing).alias("mean"),
                F.lit(None if middle is None else float(middle)).cast("double").alias("median"),
                (F.col(f"std{i}") if number else nothing).alias("std"),
                (F.col(f"min{i}") if number else nothing).alias("min"),
                (F.col(f"max{i}") if number else nothing).alias("max"),
                F.lit(None if q25 is None else float(q25)).cast("double").alias("q25"),
                F.lit(None if q75 is None else float(q75)).cast("double").alias("q75"),
            )
        )
    described = from_one_row(one_row, structs)
    if not others:
        return described.withColumn("unique", F.lit(None).cast("long")).withColumn(
            "most_common", F.lit(None).cast("array<string>")
        )
    counts = value_counts(df, others)
    # Reading ``n`` here lets both uses of the counts share one shuffle.
    unique = counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("unique"))
    texts = [c for c in others if isinstance(data_type(df, c), T.StringType)]
    shown = F.when(F.col("column").isin(texts), F.array_sort(F.collect_list("value"))) if texts else F.lit(None)
    common = most_common(counts, modes_kept).groupBy("column").agg(shown.cast("array<string>").alias("most_common"))
    facts = unique.join(common, "column", "left")
    return described.join(F.broadcast(facts), "column", "left").select(
        "position", "column", "dtype", "count", "missing", "mean", "median", "std", "min", "max",
        "q25", "q75", "unique", "most_common",
    )


def kpis(df: DataFrame, definitions: dict[str, str | dict]) -> DataFrame:
    """One row per KPI: aggregate and value, or why there is none. An unknown aggregate is a sum."""
    known = ("sum", "mean", "min", "max", "count")
    columns, structs = [F.count(F.lit(1)).alias("rows")], []
    for i, (name, spec) in enumerate(definitions.items()):
        agg = spec if isinstance(spec, str) else (spec or {}).get("agg", "sum")
        used = agg if agg in known else "sum"
        error, value = None, F.lit(None).cast("double")
        if name not in df.columns:
            error = "column not found"
        elif not is_numeric(data_type(df, name)):
            error = "column is not numeric"
        elif used == "count":
            value = F.col("rows").cast("double")
        else:
            made = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[used](col(name))
            columns.append((F.coalesce(made, F.lit(0)) if used == "sum" else made).cast("double").alias(f"v{i}"))
            value = F.col(f"v{i}")
        structs.append(
            F.struct(
                F.lit(name).alias("kpi"),
                F.lit(None if error else agg).cast("string").alias("agg"),
                value.alias("value"),
                F.lit(error).cast("string").alias("error"),
            )
        )
    return from_one_row(df.agg(*columns), structs)


# --- correlation ------------------------------------------------------------------------


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The chosen columns of rows without a null in any of them."""
    return df.select(*map(col, columns)).filter(reduce(and_, [col(c).isNotNull() for c in columns]))


def _correlation(a: Column, b: Column) -> Column:
    """Pearson's r over rows that have both; null when a side does not vary."""
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_samp(F.when(both, a)) * F.stddev_samp(F.when(both, b))
    return F.try_divide(F.covar_samp(a, b), spread)


def _pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, corr, rows) for each pair; many pairs share one pass, very many take several."""
    parts = []
    for at in range(0, len(pairs), PAIRS_PER_PASS):
        some = pairs[at : at + PAIRS_PER_PASS]
        one = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[_correlation(col(a), col(b)).alias(f"r{i}") for i, (a, b) in enumerate(some)],
        )
        parts.append(
            from_one_row(
                one,
                [
                    F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr"), "rows")
                    for i, (a, b) in enumerate(some)
                ],
            )
        )
    return reduce(DataFrame.unionByName, parts)


def correlation_matrix(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, corr) for every ordered pair of numeric columns, over rows complete in all of them."""
    if method not in ("pearson", "spearman"):
        raise InvalidRequest("method must be pearson or spearman")
    names = list(columns) if columns else numeric_columns(df)
    if columns:
        names = require_numeric(df, names)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    work = complete_rows(df, names)
    if method == "spearman":
        work = with_average_ranks(work, names)
    upper = _pairs(work, [(a, b) for i, a in enumerate(names) for b in names[i:]])
    upper = upper.withColumn("corr", half_up(F.col("corr"), 6))
    both_ways = F.when(
        F.col("a") == F.col("b"), F.array(F.struct("a", "b", "corr"))
    ).otherwise(
        F.array(F.struct("a", "b", "corr"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    )
    return upper.select(F.inline(both_ways))


def top_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, at_least: float = 0.3, limit: int = 10
) -> DataFrame:
    """The strongest pairs, each over the rows that have both values."""
    names = list(columns or numeric_columns(df))
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    found = _pairs(df, [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]])
    return (
        found.filter(F.abs("corr") >= at_least)
        .drop("rows")
        .withColumn("corr", half_up(F.col("corr"), 4))
        .orderBy(F.abs("corr").desc(), "a", "b")
        .limit(limit)
    )


# --- anomalies --------------------------------------------------------------------------


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows complete in the columns, a z-score per column and their largest as ``score``.

    The moments are read once, so that every later pass computes the very same scores.
    """
    names = require_numeric(df, columns)
    work = complete_rows(df, names)
    moments = work.agg(
        *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_samp(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    z = []
    for i, c in enumerate(names):
        mean, std = moments[f"m{i}"], moments[f"s{i}"]
        flat = mean is None or not std
        z.append(F.lit(0.0) if flat else F.abs(col(c).cast("double") - F.lit(mean)) / F.lit(std))
    scored = work.select(*map(col, names), *[e.alias(f"z_{c}") for c, e in zip(names, z)])
    tops = [col(f"z_{c}") for c in names]
    return scored.withColumn("score", F.greatest(*tops) if len(tops) > 1 else tops[0])


def anomalies(df: DataFrame, columns: Sequence[str], contamination: float = 0.1) -> DataFrame:
    """All rows whose score reaches the (1 - contamination) nearest-rank quantile of scores."""
    scored = z_scores(df, columns)
    threshold = order_statistics(scored, [Target.nearest("score", 1.0 - contamination)])[0]
    return scored.filter(F.col("score") >= F.lit(threshold or 0.0))


def top_anomalies(df: DataFrame, columns: Sequence[str], contamination: float = 0.1, limit: int = 100) -> DataFrame:
    """The rows with the highest scores, with the number of anomalies beside them."""
    found = anomalies(df, columns, contamination)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        found.orderBy(F.desc("score"), *[col(c) for c in found.columns])
        .limit(limit)
        .withColumn("anomaly_count", total)
    )
