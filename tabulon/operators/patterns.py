"""Notable patterns: skew, strong pairs, rare groups, concentration, missing cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabulon.functions.rounding import half_up
from tabulon.functions.schema import col, numeric_columns, require_columns
from tabulon.operators.ordering import medians
from tabulon.operators.profile import from_one_row, missing_counts
from tabulon.operators.stats import _pairs, complete_rows

# From where on a pattern is reported.
SKEW_AT, MIN_ROWS, PAIR_AT = 0.35, 10, 0.55
RARE_GROUPS, RARE_OF, RARE_PCT = 3, 5, 2.0
CONCENTRATED_OF, CONCENTRATED_AT = 2, 0.18
MISSING_PCT = 10.0


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "kind string, subject string, strength double")


def skew(
    df: DataFrame, columns: Sequence[str] | None = None, middle: dict[str, float | None] | None = None
) -> DataFrame:
    """Columns whose mean lies far from the median, in deviations. Known medians may be given."""
    names = list(columns or numeric_columns(df))
    if not names:
        return _empty(df)
    if middle is None:
        middle = medians(df, names)
    one = df.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_samp(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)],
    )
    rows = from_one_row(
        one,
        [
            F.struct(
                F.lit("skew").alias("kind"), F.lit(c).alias("subject"), F.col(f"n{i}").alias("n"),
                F.try_divide(F.col(f"m{i}") - F.lit(middle[c]).cast("double"), F.col(f"s{i}")).alias("strength"),
            )
            for i, c in enumerate(names)
        ],
    )
    return rows.filter((F.col("n") >= MIN_ROWS) & (F.abs("strength") >= SKEW_AT)).select(
        "kind", "subject", half_up(F.col("strength"), 3).alias("strength")
    )


def strong_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strongly correlated pairs over rows complete in all looked-at columns."""
    names = list(columns or numeric_columns(df))
    if len(names) < 2:
        return _empty(df)
    found = _pairs(complete_rows(df, names), [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]])
    return found.filter((F.abs("corr") >= PAIR_AT) & (F.col("rows") >= MIN_ROWS)).select(
        F.lit("correlation").alias("kind"),
        F.concat("a", F.lit(" ~ "), "b").alias("subject"),
        half_up(F.col("corr"), 3).alias("strength"),
    )


def _group_sizes(df: DataFrame, key: str) -> DataFrame:
    require_columns(df, [key])
    return df.groupBy(col(key).alias("group")).agg(F.count(F.lit(1)).alias("n"))


def rare_groups(df: DataFrame, key: str) -> DataFrame:
    """The three smallest groups, when there are enough groups and they are rare."""
    sizes = _group_sizes(df, key)
    named = sizes.filter(F.col("group").isNotNull())
    facts = sizes.agg(
        F.struct(F.sum("n").alias("rows"), F.count("group").alias("groups")).alias("f")
    ).scalar()
    share = 100.0 * F.col("n") / facts["rows"]
    return (
        named.orderBy("n", "group")
        .limit(RARE_GROUPS)
        .filter((facts["groups"] >= RARE_OF) & (share <= RARE_PCT))
        .select(
            F.lit("rare").alias("kind"),
            F.concat(F.lit(f"{key}="), F.col("group").cast("string")).alias("subject"),
            half_up(share, 2).alias("strength"),
        )
    )


def concentrated(df: DataFrame, key: str) -> DataFrame:
    """The concentration index of row shares, when few groups dominate."""
    index = F.try_divide(
        F.sum(F.when(F.col("group").isNotNull(), F.col("n").cast("double") * F.col("n"))),
        F.sum("n").cast("double") * F.sum("n"),
    )
    return (
        _group_sizes(df, key)
        .agg(F.count("group").alias("groups"), index.alias("hhi"))
        .filter((F.col("groups") >= CONCENTRATED_OF) & (F.col("hhi") >= CONCENTRATED_AT))
        .select(
            F.lit("concentration").alias("kind"), F.lit(key).alias("subject"), half_up(F.col("hhi"), 3).alias("strength")
        )
    )


def missing_pattern(df: DataFrame) -> DataFrame:
    """Columns with many missing cells."""
    pct = F.try_divide(100.0 * F.col("missing"), F.col("rows"))
    return (
        missing_counts(df, df.columns)
        .filter(pct >= MISSING_PCT)
        .select(F.lit("missing").alias("kind"), F.col("column").alias("subject"), half_up(pct, 1).alias("strength"))
    )


def patterns(
    df: DataFrame,
    key: str | None,
    metrics: Sequence[str] | None = None,
    limit: int | None = None,
    middle: dict[str, float | None] | None = None,
) -> DataFrame:
    """All patterns of all columns, the strongest first."""
    found = skew(df, metrics, middle).unionByName(strong_pairs(df)).unionByName(missing_pattern(df))
    if key:
        found = found.unionByName(rare_groups(df, key)).unionByName(concentrated(df, key))
    found = found.orderBy(F.abs("strength").desc(), "kind", "subject")
    return found if limit is None else found.limit(limit)
