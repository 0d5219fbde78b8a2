"""Order-dependent results without sorting a whole table in one task.

Exact quantiles narrow a bracket around the wanted rank. Ranks, row numbers and forward fill deal the rows into ranges of
the whole order tuple, kept sorted as they were dealt, solve each range by itself and carry one row from range to range.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from tabulon.errors import InvalidRequest
from tabulon.functions.schema import col, data_type, fresh_name, require_columns
from tabulon.session import computed_once

ACCURACY = 10_000
BRACKET_ROWS = 1_000_000
ROWS_PER_BUCKET = 1_000_000
SMALL_BUCKET = 1_000
#: A table with a row per range is broadcast up to this size; beyond it the planner joins it as it sees fit.
BROADCAST_BYTES = 64 << 20


# --- exact order statistics -------------------------------------------------------------


@dataclass(frozen=True)
class Target:
    """A fraction of a column's sorted values, and the 0-based rank it means for n values."""

    column: str
    fraction: float
    rank: Callable[[int], int]

    @staticmethod
    def nearest(column: str, fraction: float) -> Target:
        return Target(column, fraction, lambda n: math.floor((n - 1) * fraction + 0.5))

    @staticmethod
    def medians(column: str) -> tuple[Target, Target]:
        return (
            Target(column, 0.5, lambda n: (n - 1) // 2),
            Target(column, 0.5, lambda n: n // 2),
        )


@dataclass
class _Bracket:
    column: str
    rank: int
    low: Any
    high: Any
    below: int = 0
    inside: int = 0

    def covers(self) -> Column:
        return (col(self.column) >= F.lit(self.low)) & (col(self.column) <= F.lit(self.high))

    def settled(self) -> bool:
        return self.low == self.high or self.inside <= BRACKET_ROWS


def _count_where(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def _around(targets: Sequence[Target]) -> dict[str, list[float]]:
    """Per column the fractions between which its targets lie."""
    margin = 2.0 / ACCURACY
    around: dict[str, list[float]] = {c: [] for c in sorted({t.column for t in targets})}
    for t in targets:
        around[t.column] += [max(0.0, t.fraction - margin), min(1.0, t.fraction + margin)]
    return around


def sketches(df: DataFrame, targets: Sequence[Target], more: Sequence[Column] = ()) -> Row:
    """What the search for order statistics reads first, of all columns in one pass, and any other aggregates with it."""
    return df.agg(
        *more,
        *[
            made.alias(f"__{stem}{i}")
            for i, (c, fractions) in enumerate(_around(targets).items())
            for stem, made in (
                ("n", F.count(col(c))),
                ("min", F.min(col(c))),
                ("max", F.max(col(c))),
                ("sketch", F.percentile_approx(col(c), fractions, ACCURACY)),
            )
        ],
    ).first()


def order_statistics(df: DataFrame, targets: Sequence[Target], first: Row | None = None) -> list[Any]:
    """The exact value at each target's rank, None for a column without values.

    Three passes for any number of columns: sketches bracket every rank, counters prove the brackets, and only values
    inside a bracket are counted and sorted. A bracket with very many rows is narrowed again, as long as that moves one of
    its ends; one that stays has heavy ends, which are one row each when its values are counted. ``first`` is the
    result of ``sketches``, where that pass was made with others.
    """
    if not targets:
        return []
    first = sketches(df, targets) if first is None else first
    columns, margin = list(_around(targets)), 2.0 / ACCURACY
    brackets: list[_Bracket | None] = []
    taken = dict.fromkeys(columns, 0)
    for t in targets:
        i = columns.index(t.column)
        n = first[f"__n{i}"]
        if n == 0:
            brackets.append(None)
            continue
        at = taken[t.column]
        low, high = first[f"__sketch{i}"][at : at + 2]
        taken[t.column] = at + 2
        low = first[f"__min{i}"] if t.fraction <= margin else low
        high = first[f"__max{i}"] if t.fraction >= 1 - margin else high
        brackets.append(_Bracket(t.column, min(max(t.rank(n), 0), n - 1), low, high))
    limits = {c: (first[f"__min{i}"], first[f"__max{i}"]) for i, c in enumerate(columns)}
    live = [b for b in brackets if b is not None]
    _prove(df, live, limits)
    wide = [b for b in live if not b.settled()]
    while wide:
        before = [(b.low, b.high) for b in wide]
        _narrow(df, wide)
        _prove(df, wide, limits)
        wide = [b for b, ends in zip(wide, before) if not b.settled() and (b.low, b.high) != ends]
    found = _pick(df, [b for b in live if b.low != b.high])
    return [None if b is None else b.low if b.low == b.high else found[id(b)] for b in brackets]


def _prove(df: DataFrame, brackets: list[_Bracket], limits: dict[str, tuple]) -> None:
    """Count rows below and inside; a bracket that misses its rank is opened on that side."""
    open_ones = brackets
    while open_ones:
        counts = df.agg(
            *[_count_where(col(b.column) < F.lit(b.low)).alias(f"below{i}") for i, b in enumerate(open_ones)],
            *[_count_where(b.covers()).alias(f"inside{i}") for i, b in enumerate(open_ones)],
        ).first()
        missed = []
        for i, b in enumerate(open_ones):
            b.below, b.inside = counts[f"below{i}"], counts[f"inside{i}"]
            if b.rank < b.below:
                b.low = limits[b.column][0]
                missed.append(b)
            elif b.rank >= b.below + b.inside:
                b.high = limits[b.column][1]
                missed.append(b)
        open_ones = missed


def _narrow(df: DataFrame, brackets: list[_Bracket]) -> None:
    margin = 2.0 / ACCURACY
    exprs = []
    for i, b in enumerate(brackets):
        inside = F.when(b.covers(), col(b.column))
        at = (b.rank - b.below + 0.5) / b.inside
        exprs.append(
            F.percentile_approx(inside, [max(0.0, at - margin), min(1.0, at + margin)], ACCURACY).alias(f"t{i}")
        )
    row = df.agg(*exprs).first()
    for i, b in enumerate(brackets):
        b.low, b.high = row[f"t{i}"]


def _pick(df: DataFrame, brackets: list[_Bracket]) -> dict[int, Any]:
    """Sort the distinct values inside each bracket and read the one at the rank."""
    found: dict[int, Any] = {}
    by_type: dict[str, list[tuple[int, _Bracket]]] = {}
    for i, b in enumerate(brackets):
        by_type.setdefault(_common_type(df, b), []).append((i, b))
    for dtype, group in by_type.items():
        cells = [
            F.when(b.covers(), F.struct(F.lit(i).alias("i"), col(b.column).cast(dtype).alias("v"))) for i, b in group
        ]
        skip = F.create_map(*[F.lit(x) for i, b in group for x in (i, b.rank - b.below)])[F.col("i")]
        values = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("i", "v").count()
        upto = F.sum("count").over(Window.partitionBy("i").orderBy("v"))
        at_rank = (F.col("upto") > skip) & (F.col("upto") - F.col("count") <= skip)
        for row in values.withColumn("upto", upto).filter(at_rank).select("i", "v").collect():
            bracket = brackets[row["i"]]
            found[id(bracket)] = type(bracket.low)(row["v"])
    return found


def _common_type(df: DataFrame, bracket: _Bracket) -> str:
    """Columns whose values a double holds exactly share one job."""
    dtype = data_type(df, bracket.column)
    exact = isinstance(dtype, T.IntegralType) and max(abs(bracket.low), abs(bracket.high)) <= 2**53
    return "double" if exact or isinstance(dtype, (T.DoubleType, T.FloatType)) else dtype.simpleString()


def quantiles(df: DataFrame, wanted: dict[str, Sequence[float]], exact: bool = True) -> dict[str, list[Any]]:
    """Nearest-rank quantiles of many columns; ``exact=False`` takes one pass of sketches."""
    if not exact:
        row = df.agg(
            *[F.percentile_approx(col(c), list(qs), ACCURACY).alias(f"c{i}") for i, (c, qs) in enumerate(wanted.items())]
        ).first()
        return {c: list(row[f"c{i}"] or [None] * len(qs)) for i, (c, qs) in enumerate(wanted.items())}
    flat = [(c, q) for c, qs in wanted.items() for q in qs]
    values = order_statistics(df, [Target.nearest(c, q) for c, q in flat])
    out: dict[str, list[Any]] = {c: [] for c in wanted}
    for (c, _), v in zip(flat, values):
        out[c].append(v)
    return out


def _middle(low: Any, high: Any) -> float | None:
    return None if low is None else (float(low) + float(high)) / 2


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Interpolated medians of many columns."""
    values = order_statistics(df, [t for c in columns for t in Target.medians(c)])
    return {c: _middle(values[2 * i], values[2 * i + 1]) for i, c in enumerate(columns)}


def quartile_targets(columns: Sequence[str]) -> list[Target]:
    return [t for c in columns for t in (Target.nearest(c, 0.25), *Target.medians(c), Target.nearest(c, 0.75))]


def quartiles(df: DataFrame, columns: Sequence[str], first: Row | None = None) -> dict[str, tuple]:
    """(nearest lower quartile, interpolated median, nearest upper quartile) of many columns."""
    values = order_statistics(df, quartile_targets(columns), first)
    groups = {c: values[4 * i : 4 * i + 4] for i, c in enumerate(columns)}
    return {c: (q1, _middle(low, high), q3) for c, (q1, low, high, q3) in groups.items()}


# --- ranges of the order ----------------------------------------------------------------


def _bucket_count(df: DataFrame) -> int:
    rows = df.count()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(rows // ROWS_PER_BUCKET, min(partitions, 1 + rows // SMALL_BUCKET))


def _nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))


def _in_ranges(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """The rows dealt into ranges of the whole order tuple and sorted inside them, nulls first and NaN last.

    Spark samples the tuples for split points. Equal tuples are told apart by a hash of the row and equal rows by
    their number, so any number of them is cut like others.
    """
    for c in order:
        if "map<" in data_type(df, c).simpleString():
            raise InvalidRequest(f"order column '{c}' holds maps, which have no order")
    tie, row = fresh_name(df, "tie"), fresh_name(df, "row")
    hashed = [col(c) for c in df.columns if "map<" not in data_type(df, c).simpleString()]
    by = [*[col(c).asc_nulls_first() for c in order], F.col(tie), F.col(row)]
    work = df.withColumn(tie, F.xxhash64(*hashed)).withColumn(row, F.monotonically_increasing_id())
    return work.repartitionByRange(buckets or _bucket_count(df), *by).sortWithinPartitions(*by).drop(tie, row)


def with_range_bucket(df: DataFrame, name: str, order: Sequence[str], place: str | None = None) -> DataFrame:
    """Add a bucket number that grows with the order and, where asked for, the place of each row in its bucket.

    The result is kept in the checkpoint folder: the same rows lie in the same buckets in every pass over it, also
    when an executor is lost.
    """
    out = _in_ranges(df, order).withColumn(name, F.spark_partition_id().cast("long"))
    if place is not None:
        out = out.withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return computed_once(out)


def _counted_before(sizes: DataFrame, bucket: str, size: str, name: str) -> DataFrame:
    """(bucket, name): rows before each bucket, counted inside groups of buckets and over the groups."""
    group = F.shiftright(bucket, 8)
    inside = Window.partitionBy("__group").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    outside = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    grouped = sizes.withColumn("__group", group)
    groups = grouped.groupBy("__group").agg(F.sum(size).alias("__size"))
    groups = groups.select("__group", F.coalesce(F.sum("__size").over(outside), F.lit(0)).alias("__before"))
    found = grouped.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(groups, "__group")
    return found.select(bucket, (F.col("__before") + F.col("__inside")).alias(name))


# --- average ranks ----------------------------------------------------------------------


def _running_total(df: DataFrame, counts: str, name: str) -> DataFrame:
    """Add the sum of the counts up to each row of its task, in the order the rows lie in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            upto = total + np.cumsum(batch.column(counts).to_numpy())
            total = int(upto[-1]) if len(upto) else total
            yield batch.append_column(name, pa.array(upto, pa.int64()))

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    return df.mapInArrow(add, schema)


def _rank_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    return "double" if isinstance(dtype, (T.FloatType, T.DoubleType)) else dtype.simpleString()


def _long_values(df: DataFrame, columns: Sequence[str], kept: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """One row per cell: ``column`` (its position) and the value, in one of as many value columns as there are kinds of
    types, so that no value is changed. Also the names of the value columns, and which of them each column uses."""
    types = [_rank_type(data_type(df, c)) for c in columns]
    kinds = sorted(set(types))
    names = [f"v{j}" for j in range(len(kinds))]
    cells = [
        F.struct(F.lit(i).alias("column"), *[(col(c) if kinds[j] == types[i] else F.lit(None)).cast(kinds[j]).alias(names[j]) for j in range(len(kinds))])
        for i, c in enumerate(columns)
    ]
    return df.select(*map(col, kept), F.inline(F.array(*cells))), names, [names[kinds.index(t)] for t in types]


def _ranked_values(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """(column, value, rank) of all columns. Values are counted before they are ranked, so a heavy value is one row,
    and all columns share one shuffle of the counts and one of their order."""
    cells, names, used = _long_values(df, columns)
    counts = computed_once(cells.groupBy("column", *names).agg(F.count(F.lit(1)).alias("n")).where(F.coalesce(*[F.col(v).cast("string") for v in names]).isNotNull()))
    # One row per column.
    totals = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    earlier, sums = F.create_map(F.lit(-1), F.lit(0).cast("long")), 0
    for c in sorted(totals):
        earlier, sums = F.map_concat(earlier, F.create_map(F.lit(c), F.lit(sums).cast("long"))), sums + totals[c]
    summed = _running_total(_in_ranges(counts, ["column", *names]), "n", "upto")
    placed = computed_once(summed.withColumn("bucket", F.spark_partition_id().cast("long")))
    sizes = placed.groupBy("bucket").agg(F.max("upto").alias("size"))
    # One row per range.
    offsets = F.broadcast(_counted_before(sizes, "bucket", "size", "before"))
    rank = F.col("before") + F.col("upto") - earlier[F.col("column")] - (F.col("n") - 1) / 2
    return placed.join(offsets, "bucket").select("column", *names, rank.alias("rank")), names, used


def average_ranks(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Per column a table of value and average rank; equal values share their mean rank."""
    require_columns(df, columns)
    ranks, _, used = _ranked_values(df, columns)
    ranks = computed_once(ranks)
    return {
        c: ranks.where(F.col("column") == i).select(F.col(used[i]).cast(data_type(df, c)).alias("value"), "rank") for i, c in enumerate(columns)
    }


def with_average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column replaced by its average rank, null where it has none.

    Cells are looked up in the ranks of all columns at once and put back by row, so that there are as many shuffles for
    many columns as for two. A small table of ranks is broadcast; a heavy value is split by adaptive execution.
    """
    require_columns(df, columns)
    ranks, names, _ = _ranked_values(df, columns)
    row = fresh_name(df, "row")
    cells, _, _ = _long_values(df.withColumn(row, F.monotonically_increasing_id()), columns, [row])
    # The value columns that a cell does not use are null on both sides.
    looked_up = ranks.select(F.col("column").alias("c"), *[F.col(v).alias(f"r{v}") for v in names], "rank")
    same = [F.col(v).eqNullSafe(F.col(f"r{v}")) for v in names] if len(names) > 1 else [F.col(names[0]) == F.col(f"r{names[0]}")]
    found = cells.join(looked_up, reduce(and_, [F.col("column") == F.col("c"), *same]), "left")
    each = [F.max(F.when(F.col("column") == i, F.col("rank"))).alias(f"rank{i}") for i in range(len(columns))]
    return found.groupBy(col(row)).agg(*each).select(*[F.col(f"rank{i}").alias(c) for i, c in enumerate(columns)])


# --- forward fill -----------------------------------------------------------------------


def _runs(keys: Sequence[pa.Array], n: int) -> np.ndarray:
    """Where a row has another key than the one before; null and NaN equal themselves."""
    begins = np.zeros(n, bool)
    begins[0] = True
    for key in keys:
        codes = key.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    return begins


def _filled(keys: Sequence[str], fill: Sequence[str], head: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fill the rows of one task, and mark those of its first key, which rows of other tasks may precede."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            both = (table if last is None else pa.concat_tables([last, table])).combine_chunks()
            n = both.num_rows
            begins = _runs([both[k].chunk(0) for k in keys], n)
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(begins, at, 0))
            for c in fill:
                held = both[c].chunk(0).is_valid().to_numpy(zero_copy_only=False)
                source = np.maximum.accumulate(np.where(held, at, -1))
                taken = both[c].take(pa.array(np.where(source >= start, source, -1), mask=source < start))
                both = both.set_column(both.schema.get_field_index(c), both.schema.field(c), taken)
            inside = (start == 0) & first
            first = bool(inside[-1])
            skip = 0 if last is None else 1
            last = both.slice(n - 1, 1)
            out = both.slice(skip).append_column(head, pa.array(inside[skip:]))
            yield from out.combine_chunks().to_batches()

    return run


def forward_fill(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Fill nulls with the last value before them in the given order.

    Rows are dealt into ranges of (key, order) and filled where they lie; what a range ends with is carried on, one row
    per range. So neither the whole table nor a heavy key lies in one task, and the rows are shuffled once.
    """
    require_columns(df, [*order_by, *partition_by])
    if not order_by:
        raise InvalidRequest("forward fill needs an order")
    fill = [c for c in (columns or df.columns) if c not in order_by and c not in partition_by]
    require_columns(df, fill)
    work, keys = df, []
    for c in partition_by:
        # Equal keys must look alike: no negative zero, and nested ones as text.
        dtype, key = data_type(df, c), fresh_name(work, "key")
        alike = F.to_json(F.struct(col(c))) if _nested(dtype) else col(c) + 0 if isinstance(dtype, (T.FloatType, T.DoubleType)) else col(c)
        work, keys = work.withColumn(key, alike), [*keys, key]
    head, bucket, place = (fresh_name(work, n) for n in ("head", "bucket", "place"))
    ranges = _in_ranges(work, [*keys, *order_by])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in ranges.schema], T.StructField(head, T.BooleanType())])
    filled = ranges.mapInArrow(_filled(keys, fill, head), schema)
    filled = computed_once(
        filled.withColumn(bucket, F.spark_partition_id().cast("long")).withColumn(place, F.monotonically_increasing_id())
    )
    carried = _carried(filled, keys, fill, head, bucket, place)
    names = {c: f"__carried{i}" for i, c in enumerate(fill)}
    both = filled.join(carried, bucket, "left")
    return both.select(*[F.coalesce(col(c), F.when(F.col(head), F.col(names[c]))).alias(c) if c in names else col(c) for c in df.columns])


def _carried(filled: DataFrame, keys: Sequence[str], fill: Sequence[str], head: str, bucket: str, place: str) -> DataFrame:
    """For each range what the ranges before it end with, for the key it begins with."""
    last = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[col(c).alias(f"v{i}") for i, c in enumerate(fill)], F.col(head).alias("one"))
    first = F.struct(F.lit(0).alias("k"), *[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    ends = filled.groupBy(bucket).agg(F.max_by(last, place).alias("last"), F.min_by(first, place).alias("first"))
    names, values = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(fill))]
    after = ends.select(bucket, F.lit(1).alias("side"), F.col("last.one").alias("opens"), *[F.col(f"last.{x}") for x in (*names, *values)])
    before = ends.where(~F.col("last.one")).select(
        bucket, F.lit(0).alias("side"), F.lit(True).alias("opens"), *[F.col(f"first.{k}") for k in names],
        *[F.lit(None).cast(data_type(filled, c)).alias(v) for c, v in zip(fill, values)],
    )
    both = after.unionByName(before).withColumn("__group", F.shiftright(bucket, 8))
    # Carried inside groups of ranges, and from group to group.
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*names, "__group").orderBy(bucket, "side").rowsBetween(*earlier)
    whole = Window.partitionBy(*names, "__group").orderBy(bucket, "side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outside = Window.partitionBy(*names).orderBy("__group").rowsBetween(*earlier)
    ranked = both.select(
        "*", *[F.last(v, ignorenulls=True).over(inside).alias(f"in_{v}") for v in values],
        *[F.last(v, ignorenulls=True).over(whole).alias(f"all_{v}") for v in values],
        F.row_number().over(Window.partitionBy(*names, "__group").orderBy(bucket, "side")).alias("nth"),
    )
    groups = ranked.where("nth = 1").select("__group", *names, *[F.last(f"all_{v}", ignorenulls=True).over(outside).alias(f"out_{v}") for v in values])
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("__group", *names)]
    joined = ranked.where("opens").alias("a").join(groups.alias("b"), same)
    found = computed_once(joined.select(
        F.col(f"a.{bucket}").alias(bucket), *[F.coalesce(f"a.in_{v}", f"b.out_{v}").alias(f"__carried{i}") for i, v in enumerate(values)]
    ))
    return _broadcast_if_small(found)


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    """The table marked for broadcast where its rows, written as text, are small enough."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


# --- row numbers ------------------------------------------------------------------------


def row_numbers(df: DataFrame, order_by: Sequence[str], name: str = "row_number") -> DataFrame:
    """1-based row numbers in the given order, counted per range and shifted by what lies before; one shuffle."""
    require_columns(df, order_by)
    bucket, place = fresh_name(df, "bucket"), fresh_name(df, "place")
    work = with_range_bucket(df, bucket, order_by, place)
    sizes = work.groupBy(bucket).agg(F.count(F.lit(1)).alias("__size"))
    # One row per range.
    offsets = F.broadcast(_counted_before(sizes, bucket, "__size", "__before"))
    return work.join(offsets, bucket).select(
        *map(col, df.columns), (F.col("__before") + F.col(place) + 1).cast("long").alias(name)
    )
