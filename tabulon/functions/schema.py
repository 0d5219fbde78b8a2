"""Questions about a DataFrame's schema; none of them starts a job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.errors import InvalidRequest

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATE_TYPES)


def kind_of(dtype: T.DataType) -> str:
    """The four kinds a user sees: number, datetime, boolean, string."""
    if is_numeric(dtype):
        return "number"
    if is_temporal(dtype):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "string"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def require_columns(df: DataFrame, names: Iterable[str], role: str = "column") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise InvalidRequest(f"unknown {role}: {', '.join(missing)}")


def require_numeric(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Keep the numeric ones of ``names``; it is an error when none is left."""
    require_columns(df, names)
    kept = [n for n in names if is_numeric(data_type(df, n))]
    if not kept:
        raise InvalidRequest("none of the chosen columns is numeric")
    return kept


def fresh_name(df: DataFrame, stem: str) -> str:
    """A helper column name that no column of ``df`` has."""
    name = f"__{stem}"
    while name in df.columns:
        name = "_" + name
    return name


def columns_meta(df: DataFrame) -> DataFrame:
    """One row per column: position, name, dtype and kind."""
    rows = [
        (i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, name string, dtype string, kind string")
