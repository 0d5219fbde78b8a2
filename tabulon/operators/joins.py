"""Equi-joins of two tables on equally long key lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabulon.errors import EmptyInput, InvalidRequest
from tabulon.functions.schema import col, data_type, require_columns
from tabulon.operators.samples import head_sample

# Join kinds, and the marks for names both sides have.
KINDS = ("inner", "left", "right", "full", "semi", "anti")
OVERLAP_MARK = "__right"
FULL_KEY_MARK = "_r"
COPIES = 16
#: Rows of one key that one task of an outer join may get from a side, and tasks that rows without a key are dealt to.
HEAVY_ROWS = 1_000_000
NULL_SALTS = 1024


def _check(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str):
    if how not in KINDS:
        raise InvalidRequest(f"join kind must be one of {', '.join(KINDS)}")
    if not left_on or len(left_on) != len(right_on):
        raise InvalidRequest("both sides need the same number of join keys")
    require_columns(left, left_on, "left join key")
    require_columns(right, right_on, "right join key")


def lookup_keys(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The keys of a looked-up side, each a few times at most, so that none is heavy.

    Fully distinct keys would already lie as the join wants them, and a join that does not
    shuffle a side itself cannot split a heavy key of the other one.
    """
    copy = F.pmod(F.spark_partition_id(), F.lit(COPIES)).alias("__copy")
    return df.select(*[col(k).alias(n) for k, n in zip(keys, names)], copy).distinct().drop("__copy")


def _has_keys(keys: Sequence[str]) -> Column:
    return reduce(and_, [col(k).isNotNull() for k in keys])


def _keep_by_key(
    df: DataFrame, other: DataFrame, on: Sequence[str], other_on: Sequence[str], how: str
) -> DataFrame:
    keys = lookup_keys(other, other_on, [f"__key_{i}" for i in range(len(on))])
    return df.join(keys, reduce(and_, [col(k) == F.col(f"__key_{i}") for i, k in enumerate(on)]), how)


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join with left columns first, then right ones; names both sides have get a mark.

    Adaptive execution can split a heavy key on either side of an inner join, but only on one side of an outer join and
    on none of a full one. So outer joins count the rows of each key first (``_dealt``); then each side is shuffled
    once, its heavy keys and its rows without a key dealt to several tasks.
    """
    right_on = list(right_on or left_on)
    left_on = list(left_on)
    _check(left, right, left_on, right_on, how)
    if how in ("semi", "anti"):
        return _keep_by_key(left, right, left_on, right_on, f"left_{how}")

    renamed = {}
    for c in right.columns:
        if c in right_on:
            taken = c in left.columns and (how == "full" or c not in left_on)
            mark = FULL_KEY_MARK if how == "full" else OVERLAP_MARK
            renamed[c] = f"{c}{mark}" if taken else c
        else:
            renamed[c] = f"{c}{OVERLAP_MARK}" if c in left.columns else c
    keys = {r: f"__right_key_{i}" for i, r in enumerate(right_on)}
    marked = right.select(*[col(c).alias(keys.get(c, renamed[c])) for c in right.columns])
    marked_on = [keys[r] for r in right_on]

    left_part = [col(c) for c in left.columns if how != "right" or c not in left_on]
    right_part = [
        col(keys.get(c, renamed[c])).alias(renamed[c]) for c in right.columns if how != "left" or c not in right_on
    ]
    if how == "inner":
        right_part = [col(renamed[c]) for c in right.columns if c not in right_on]

    same = [col(l) == col(r) for l, r in zip(left_on, marked_on)]
    if how == "inner":
        return left.join(marked, reduce(and_, same), "inner").select(*left_part, *right_part)
    one, two = _dealt(left, marked, left_on, marked_on)
    joined = one.join(two, reduce(and_, [*same, F.col("__salt_left") == F.col("__salt_right")]), how)
    # A copy that met no row of the other side in its task has partners in another one.
    lone = F.col("__salt_left").isNull() | F.col("__salt_right").isNull()
    paired = F.coalesce("__paired_left", "__paired_right", F.lit(False))
    return joined.where(~(lone & paired)).select(*left_part, *right_part)


def _dealt(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt to be joined by, and whether a heavy key has rows on both of them.

    Of a key with more than ``HEAVY_ROWS`` rows the longer side is dealt out by salt and the shorter one copied to each
    salt; without rows on the shorter side nothing is copied. Rows without a key are dealt out, having no partners.
    """
    names = [f"__heavy_{i}" for i in range(len(left_on))]

    def counted(df: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
        present = df.filter(_has_keys(keys)).groupBy(*[col(k).alias(n) for k, n in zip(keys, names)])
        sides = [F.count(F.lit(1)) if i == side else F.lit(0).cast("long") for i in (0, 1)]
        return present.agg(sides[0].alias("__l"), sides[1].alias("__r"))

    heavy = None
    if all(_same_kind(data_type(left, l), data_type(right, r)) for l, r in zip(left_on, right_on)):
        rows = counted(left, left_on, 0).unionByName(counted(right, right_on, 1)).groupBy(*names).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
        # As many rows as there are times HEAVY_ROWS rows in both tables, at most.
        heavy = F.broadcast(rows.where(F.col("__l") + F.col("__r") > HEAVY_ROWS).select(
            *names, ((F.col("__l") > 0) & (F.col("__r") > 0)).alias("__both"), (F.col("__l") >= F.col("__r")).alias("__longer"),
            F.ceil(F.greatest("__l", "__r") / F.lit(HEAVY_ROWS)).cast("int").alias("__salts"),
        ))

    def salted(df: DataFrame, keys: Sequence[str], side: str, longer: Column) -> DataFrame:
        number = F.monotonically_increasing_id()
        alone = F.array((number % NULL_SALTS).cast("int"))
        if heavy is None:
            salts, paired = F.when(_has_keys(keys), F.array(F.lit(0))).otherwise(alone), F.lit(False)
        else:
            df = df.join(heavy, reduce(and_, [col(k) == F.col(n) for k, n in zip(keys, names)]), "left")
            copied = F.col("__both") & ~longer
            salts = (
                F.when(~_has_keys(keys), alone).when(F.col("__salts").isNull(), F.array(F.lit(0)))
                .when(copied, F.sequence(F.lit(0), F.col("__salts") - 1)).otherwise(F.array((number % F.col("__salts")).cast("int")))
            )
            paired = F.coalesce("__both", F.lit(False))
        kept = [col(c) for c in df.columns if c not in (*names, "__both", "__longer", "__salts")]
        return df.select(*kept, paired.alias(f"__paired_{side}"), F.explode(salts).alias(f"__salt_{side}"))

    return salted(left, left_on, "left", F.col("__longer")), salted(right, right_on, "right", ~F.col("__longer"))


def _same_kind(one: T.DataType, two: T.DataType) -> bool:
    """Whether both types become one in the same way when keys are compared and when they are counted."""
    return one == two or (isinstance(one, T.NumericType) and isinstance(two, T.NumericType))


def join_preview(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """One row: rows of both sides and of the join, and the joined column names.

    The joined rows are counted from per-key counts, so a heavy key costs one row.
    """
    right_on = list(right_on or left_on)
    _check(left, right, left_on, right_on, how)
    names = join_tables(left, right, left_on, right_on, how).columns
    one = F.count(F.lit(1))
    l = left.groupBy(*[col(k).alias(f"k{i}") for i, k in enumerate(left_on)]).agg(one.alias("l"))
    r = right.groupBy(*[col(k).alias(f"k{i}") for i, k in enumerate(right_on)]).agg(one.alias("r"))
    pairs = l.join(r, [f"k{i}" for i in range(len(left_on))], "full")
    hit = F.col("l").isNotNull() & F.col("r").isNotNull()
    lone_left, lone_right = F.col("l").isNotNull() & ~hit, F.col("r").isNotNull() & ~hit
    size = F.when(hit, F.col("l") if how == "semi" else F.lit(0) if how == "anti" else F.col("l") * F.col("r"))
    if how in ("left", "full", "anti"):
        size = size.when(lone_left, F.col("l"))
    if how in ("right", "full"):
        size = size.when(lone_right, F.col("r"))

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    return pairs.agg(
        total(F.col("l")).alias("left_rows"),
        total(F.col("r")).alias("right_rows"),
        total(size).alias("joined_rows"),
    ).withColumn("columns", F.lit(",".join(names)))


def join_sample(joined: DataFrame, rows: int = 200) -> DataFrame:
    """A look at the joined rows, the same ones on each run."""
    return head_sample(joined, rows)


def require_rows(joined: DataFrame) -> DataFrame:
    """An empty join is refused before it is saved."""
    if joined.isEmpty():
        raise EmptyInput("the join has no rows")
    return joined


def unique_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; computing them fails if two have the same key."""
    again = F.count(F.lit(1)).over(Window.partitionBy(*map(col, keys)))
    checked = source.withColumn("__times", again)
    fine = F.when(F.col("__times") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a key occurs twice in the source")).cast("boolean"))
    return checked.filter(fine).select(*map(col, source.columns))
