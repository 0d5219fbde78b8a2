"""Questions about keys, answered to those who hold them, without gathering the rows of a key.

A task first settles what it can see in its own batch: of the holders of a key one goes on, the others know enough
already. So a key that a third of all documents hold sends one row per batch to its partition. There the rows are sorted
and read as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.arrays import signed

#: What tasks emit: a key, what holds it, who is told, which question it belongs to, and whether it is settled.
ROWS = "key long, member long, owner long, question int, settled boolean"
_TOLD = "owner long, key long, member long, question int"


def _batch(key, member, owner, question, settled) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [signed(key), signed(member), signed(owner), pa.array(question, pa.int32()), pa.array(settled, pa.bool_())],
        names=["key", "member", "owner", "question", "settled"],
    )


def _sorted_once(key, member, owner, question):
    key, member, owner = (np.asarray(x).view(np.int64) for x in (key, member, owner))
    order = np.lexsort((owner, member, key))
    key, member, owner, question = key[order], member[order], owner[order], question[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
    return key[fresh], member[fresh], owner[fresh], question[fresh]


def _alike(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows begin a key, and which have a neighbour with the same key."""
    begins = np.ones(len(key), bool)
    begins[1:] = key[1:] != key[:-1]
    ends = np.append(begins[1:], True)
    return begins, ~(begins & ends[: len(begins)])


def ask_shared(key: np.ndarray, member: np.ndarray, owner: np.ndarray, question: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch that ask whether a key has another member; one owner of each (key, member) asks."""
    key, member, owner, question = _sorted_once(key, member, owner, question)
    begins, alike = _alike(key)
    known, asks = np.flatnonzero(alike), np.flatnonzero(begins)
    at = np.concatenate([known, asks])
    settled = np.arange(len(at)) < len(known)
    return _batch(key[at], member[at], owner[at], question[at], settled)


def ask_earlier(key: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch that ask whether a smaller owner has the key."""
    key, member, owner, question = _sorted_once(key, owner, owner, np.zeros(len(key), np.int32))
    begins, _ = _alike(key)
    return _batch(key, member, owner, question, ~begins)


def _answers(batches: Iterator[pa.RecordBatch], shared: bool) -> Iterator[pa.RecordBatch]:
    def told(columns, keep):
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[i][keep]) for i in (2, 0, 1, 3)], names=["owner", "key", "member", "question"]
        )

    held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)]
    known = False  # whether the key of the row held back is known to have several members
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        settled = batch.column(4).to_numpy(zero_copy_only=False)
        if settled.any():
            yield told(columns, settled)
            columns = [c[~settled] for c in columns]
        columns = [np.concatenate(x) for x in zip(held, columns)]
        key, member = columns[0], columns[1]
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
        columns = [c[fresh] for c in columns]
        begins, alike = _alike(columns[0])
        if shared:
            keep = alike
            keep[columns[0] == columns[0][0]] |= known
        else:
            keep = ~begins
            keep[0] = known
        known, last = bool(keep[-1]), keep[:-1]
        yield told([c[:-1] for c in columns], last)
        held = [c[-1:] for c in columns]
        if not shared:
            known = bool(keep[-1])
    if len(held[0]) and known:
        yield told(held, np.array([True]))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _answers(batches, True)


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _answers(batches, False)


def _dealt(rows: DataFrame) -> DataFrame:
    route = F.when(F.col("settled"), F.xxhash64("owner", "key")).otherwise(F.col("key"))
    return rows.repartition(route).sortWithinPartitions("settled", "key", "member", "owner")


def told_shared(rows: DataFrame) -> DataFrame:
    """``owner, key, member, question`` where the key has several members. Rows: ``ask_shared``."""
    return _dealt(rows).mapInArrow(_shared, _TOLD)


def told_earlier(rows: DataFrame) -> DataFrame:
    """``owner, key, member, question`` where a smaller owner has the key too. Rows: ``ask_earlier``."""
    return _dealt(rows).mapInArrow(_earlier, _TOLD)


def told_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a batch in a row, and the row of the batch that each value belongs to; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    return values, np.repeat(np.arange(len(column)), sizes)


def among(names: np.ndarray, rows: np.ndarray, told: np.ndarray, told_rows: np.ndarray) -> np.ndarray:
    """Which (row, name) pairs are among those told."""
    if not len(told) or not len(names):
        return np.zeros(len(names), bool)
    factor = np.uint64(0x9E3779B97F4A7C15)
    wanted = np.sort(told + told_rows.astype(np.uint64) * factor)
    asked = names + rows.astype(np.uint64) * factor
    at = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
    return wanted[at] == asked
