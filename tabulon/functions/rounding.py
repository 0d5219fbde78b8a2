"""Rounding that does not depend on the order in which numbers were added."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions.schema import col

GUARD_DIGITS = 4


def half_up(value: Column, digits: int) -> Column:
    """Rounded half up. Sums differ in their last bits from run to run, so a value is first cut
    to more digits than asked for, else such a bit would decide which way a half goes."""
    value = value.cast("double")
    return F.round(F.round(value, digits + GUARD_DIGITS), digits)


def half_up_array(values: np.ndarray, digits: int) -> np.ndarray:
    """The same rounding for numpy arrays."""
    scale = 10.0**digits
    return np.floor(np.round(values * scale, GUARD_DIGITS) + 0.5) / scale


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All float and double columns rounded, the others as they are."""
    return df.select(
        *[
            half_up(col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else col(f.name)
            for f in df.schema.fields
        ]
    )
