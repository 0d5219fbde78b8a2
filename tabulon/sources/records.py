"""Records of text files whose quoted cells hold line breaks, read from many byte ranges of a file at once.

Whether a line starts a record or goes on inside a quoted cell depends on all lines before it. Each file split
therefore tells how it ends under either beginning and whether a record starts in it; that is one row per split.
One window over these rows settles how each split begins, and every split is then cut into records by its own task.
A record that lies in several splits is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabulon.errors import InvalidRequest
from tabulon.session import computed_once

_MARK = b"\xef\xbb\xbf"  # byte order mark at the beginning of a file


def open_after(sep: str) -> Callable[[bytes, bool], bool]:
    """Whether a quoted cell is open after a line, given whether one was open before it.

    A quote opens a cell only as its first character, a doubled quote is part of the cell, and what follows the
    closing quote belongs to the cell up to the next separator.
    """
    if len(sep) != 1 or sep in '"\r\n':
        raise InvalidRequest("cells are separated by one character that is neither a quote nor a line break")
    mark = re.escape(sep.encode("utf-8"))
    rest = rb"(?:(?!" + mark + rb").)*+"
    inside = rb'[^"]*+(?:""[^"]*+)*+'
    closed = re.compile(rb"(?:(?:\"" + inside + rb'"|(?!"))' + rest + mark + rb")*+\"" + inside, re.DOTALL)
    closing = re.compile(inside + rb'"' + rest + mark, re.DOTALL)
    closes = re.compile(inside + rb'"')

    def after(line: bytes, is_open: bool) -> bool:
        if b'"' not in line:
            return is_open
        if not is_open:
            return closed.fullmatch(line) is not None
        if closes.match(line) is None:
            return True
        cell = closing.match(line)
        return cell is not None and closed.fullmatch(line, cell.end()) is not None

    return after


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of the file, each with its file (a 64-bit hash of the path) and the start of its split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def _unmarked(line: bytes) -> bytes:
    return line[len(_MARK):] if line.startswith(_MARK) else line


def _ends(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How each split ends under either beginning; under the second one, whether a record starts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = open_after(sep)
        found: list[list] = []
        for batch in batches:
            for file, start, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "line"))):
                if not found or found[-1][:2] != [file, start]:
                    found.append([file, start, False, True, False])
                    line = line if start else _unmarked(line)
                split = found[-1]
                split[4] |= not split[3]
                if b'"' in line:
                    split[2], split[3] = after(line, split[2]), after(line, split[3])
        if found:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["file", "start", "closed", "opened", "starts"])

    return run


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """``file, start, is_open, owner``: whether a split begins inside a quoted cell, and the split in which the record
    that is open there starts. A split either keeps its beginning, turns it round, or ends alike under both."""
    ends = lines.mapInArrow(_ends(sep), "file long, start long, closed boolean, opened boolean, starts boolean")
    order = Window.partitionBy("file").orderBy("start")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum(F.when(F.col("closed") & ~F.col("opened"), 1)).over(so_far), F.lit(0))
    # What the turns up to here make of a split that ends alike under both is taken off, to be put on again later.
    fixed = F.when(F.col("closed") == F.col("opened"), F.col("closed").cast("int") + F.col("turned"))
    now = F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.max("turned").over(before), F.lit(0))
    known = ends.withColumn("turned", turned).withColumn("fixed", fixed).withColumn("is_open", now % 2 == 1)
    owner = F.last(F.when(~F.col("is_open") | F.col("starts"), F.col("start")), ignorenulls=True).over(before)
    return known.withColumn("owner", F.coalesce(owner, F.lit(0))).select("file", "start", "is_open", "owner")


def _cut(sep: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The whole records of each split, or the parts of those that leave it or come into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = open_after(sep)
        at, held, is_open, comes_in, first = None, [], False, False, False
        done: list[tuple] = []

        def give(complete: bool) -> None:
            nonlocal held, comes_in, first
            record = b"\n".join(held)
            if comes_in:  # the end of a record that another split began, or the middle of one
                if not whole:
                    done.append((at[0], at[2], at[1], False, record))
            else:
                record = record.removesuffix(b"\r") if complete else record
                if record or not complete:
                    if complete == whole:
                        done.append((at[0], at[1], at[1], first, record))
                    first = False
            held, comes_in = [], False

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            columns = zip(*done) if done else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "owner", "part", "first", "record"])

        for batch in batches:
            for file, start, owner, begins_open, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "owner", "is_open", "line"))):
                if at is None or at[:2] != (file, start):
                    if held:
                        give(False)
                    at, is_open, comes_in, first = (file, start, owner), begins_open, begins_open, start == 0
                    line = line if start else _unmarked(line)
                held.append(line)
                is_open = after(line, is_open)
                if not is_open:
                    give(True)
            if done:
                yield batch_of()
                done = []
        if held:
            give(False)
        if done:
            yield batch_of()

    return run


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``record, first``: every record of the files as text, without the line end; ``first`` marks a file's first one.

    Lines end in a line feed, with or without a carriage return. Empty lines are no records. A quoted cell that is
    never closed takes the rest of its file. The splits must be the same each time they are read, which holds while
    ``spark.sql.files.*`` and the number of cores stay; otherwise the query fails.
    """
    lines = _lines(spark, path)
    states = computed_once(split_states(lines, sep))
    # One row per file split goes to the tasks, about 30 bytes for each 128 MB read.
    met = lines.join(F.broadcast(states), ["file", "start"], "left").select(
        "file", "start", "owner", "line",
        F.coalesce("is_open", F.raise_error(F.lit("the files were split otherwise than before; read them again")).cast("boolean")).alias("is_open"),
    )
    shape = "file long, owner long, part long, first boolean, record binary"
    parts = computed_once(met.mapInArrow(_cut(sep, False), shape))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda x: x["record"].cast("string"))
    joined = parts.groupBy("file", "owner").agg(F.array_join(ordered, "\n").alias("record"), F.max("first").alias("first"))
    joined = joined.select(F.regexp_replace("record", r"\r\z", "").alias("record"), "first")
    return met.mapInArrow(_cut(sep, True), shape).select(F.col("record").cast("string").alias("record"), "first").unionAll(joined)
