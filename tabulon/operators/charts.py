"""Data behind charts: histogram bins and scatter points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabulon.functions.rounding import half_up
from tabulon.functions.schema import col, require_numeric

# Fixed value: bins of a histogram.
BINS = 12


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed, empty ones included. Null, NaN
    and infinite values have no place on the axis and are left out."""
    require_numeric(df, [column])
    number = col(column).cast("double")
    placed = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    values = df.filter(placed).select(number.alias("v"))
    low, high = F.min("v"), F.max("v")
    span = F.when(low == high, F.lit(1.0)).otherwise(high - low)
    edges = values.agg(F.struct(low.alias("low"), (span / bins).alias("width")).alias("e")).scalar()
    low, width = edges["low"], edges["width"]
    counted = (
        values.select(F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # At most ``bins`` rows are counted.
    return frame.join(F.broadcast(counted), "bin", "left").filter(low.isNotNull()).select(
        "bin",
        half_up(low + F.col("bin") * width, 2).alias("bin_low"),
        half_up(low + (F.col("bin") + 1) * width, 2).alias("bin_high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def scatter_points(
    df: DataFrame, x: str, y: str, points: int | None = None, sample_by: Sequence[str] = (), seed: int = 0
) -> DataFrame:
    """All points that have both values, or a sample of ``points`` of them: those whose hash of
    ``sample_by`` (by default the two values) and the seed is smallest."""
    require_numeric(df, [x, y])
    both = df.filter(col(x).isNotNull() & col(y).isNotNull())
    if points is not None:
        by = [col(c) for c in (sample_by or [x, y])]
        both = both.orderBy(F.xxhash64(F.lit(seed), *by), *by).limit(points)
    return both.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
