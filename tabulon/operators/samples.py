"""Looks at a table that are the same on each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.schema import col


def sortable(df: DataFrame) -> list[str]:
    """Columns usable as tie-breaks, which maps are not."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns as JSON, nulls written out."""
    return F.md5(F.to_json(F.struct(*map(col, df.columns)), {"ignoreNullFields": "false"}))


def head_sample(df: DataFrame, rows: int = 20) -> DataFrame:
    """The ``rows`` rows with the smallest hashes of their content.

    Which these are does not depend on files, partitions or the order in which tasks end. Each task keeps as many rows,
    and those are merged.
    """
    return df.orderBy(row_hash(df), *[col(c) for c in sortable(df)]).limit(rows)
