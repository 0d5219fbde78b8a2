"""Dates: tolerant parsing, period truncation, inclusive period filters."""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.errors import InvalidRequest
from tabulon.functions.schema import col, data_type, is_temporal, require_columns

GRANULARITIES = ("day", "week", "month")
_TRUNC_UNIT = {"week": "week", "month": "month"}


def as_datetime(df: DataFrame, name: str) -> Column:
    """The column as a date or timestamp; text that is no date becomes null."""
    require_columns(df, [name])
    dtype = data_type(df, name)
    if is_temporal(dtype):
        return col(name)
    if not isinstance(dtype, T.StringType):
        raise InvalidRequest(f"column '{name}' holds no dates")
    return col(name).try_cast("timestamp_ntz")


def period_start(when: Column, granularity: str) -> Column:
    """First day of the day, Monday week or month, as a date."""
    if granularity not in GRANULARITIES:
        raise InvalidRequest(f"granularity must be one of {', '.join(GRANULARITIES)}")
    day = F.to_date(when)
    unit = _TRUNC_UNIT.get(granularity)
    return day if unit is None else F.trunc(day, unit)


def period_text(when: Column, granularity: str) -> Column:
    return F.date_format(period_start(when, granularity), "yyyy-MM-dd")


def parse_boundary(value: object, end_of_day: bool = False) -> datetime:
    """A period boundary; a bare day used as an end reaches to its last microsecond."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime.combine(value, time.max if end_of_day else time.min)
    text = str(value or "").strip()
    if not text:
        raise InvalidRequest("a period boundary is missing")
    try:
        parsed = datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError as error:
        raise InvalidRequest(f"'{text}' is no ISO date") from error
    if end_of_day and len(text) <= 10:
        return datetime.combine(parsed.date(), time.max)
    return parsed


def time_literal(value: datetime, dtype: T.DataType) -> Column:
    """A literal of the column's own date type, so that the filter reaches the scan."""
    if isinstance(dtype, T.DateType):
        return F.lit(value.date())
    target = "timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz"
    return F.lit(value.isoformat(sep=" ", timespec="microseconds")).cast(target)


def in_period(df: DataFrame, name: str, start: object, end: object) -> Column:
    """Inclusive on both ends, on dates and on instants alike."""
    dtype = data_type(df, name) if name in df.columns else T.NullType()
    when = as_datetime(df, name)
    if isinstance(dtype, T.StringType):
        dtype = T.TimestampNTZType()
    low = time_literal(parse_boundary(start), dtype)
    high = time_literal(parse_boundary(end, end_of_day=True), dtype)
    return (when >= low) & (when <= high)
