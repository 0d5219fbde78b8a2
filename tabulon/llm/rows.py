"""Functions of a text, applied to whole Arrow batches, with the id or the whole row beside their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def over_texts(
    docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], results: str,
    doc_id: str, text: str, whole_rows: bool,
) -> DataFrame:
    """``run`` gets batches of ``d`` (id), ``t`` (text) and, where asked for, ``row`` (a struct of all columns)."""
    columns = [F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")]
    if whole_rows:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    source = docs.select(*columns)
    kept = ", ".join(f"{name} {source.schema[c].dataType.simpleString()}" for c, name in (("d", "doc_id"), ("row", "row")) if c in source.columns)
    return source.mapInArrow(run, f"{kept}, {results}")


def with_result(batch: pa.RecordBatch, arrays: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """A batch for the output of ``over_texts``."""
    kept = {"doc_id": batch.column("d")}
    if "row" in batch.schema.names:
        kept["row"] = batch.column("row")
    return pa.RecordBatch.from_arrays([*kept.values(), *arrays], names=[*kept, *names])
