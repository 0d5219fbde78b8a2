import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tabulon.errors import InvalidRequest
from tabulon.operators import ordering
from tabulon.operators.ordering import (
    Target, average_ranks, forward_fill, medians, order_statistics, quantiles, quartiles, row_numbers,
    with_average_ranks,
)

FRACTIONS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0)


def nearest(values, q):
    ordered = sorted(v for v in values if v is not None)
    return ordered[math.floor((len(ordered) - 1) * q + 0.5)] if ordered else None


def check_quantiles(spark, values, dtype="double"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}").repartition(3)
    assert quantiles(df, {"v": FRACTIONS})["v"] == [nearest(values, q) for q in FRACTIONS]


def test_quantiles_of_few_values(spark):
    check_quantiles(spark, [100.0, 200.0, 150.0, 300.0])
    check_quantiles(spark, [5.0])
    check_quantiles(spark, [None, 2.0, None, 1.0])
    check_quantiles(spark, [None, None])


def test_quantiles_with_a_heavy_value(spark):
    random.seed(1)
    check_quantiles(spark, [7.0] * 700 + [random.random() * 20 for _ in range(1300)])
    check_quantiles(spark, [random.randrange(5) for _ in range(1000)], "long")


def test_narrowing_brackets_stays_exact(spark, monkeypatch):
    """With tiny sketches and brackets the search needs several rounds."""
    monkeypatch.setattr(ordering, "BRACKET_ROWS", 3)
    monkeypatch.setattr(ordering, "ACCURACY", 10)
    random.seed(2)
    check_quantiles(spark, [random.gauss(0, 1) for _ in range(800)])
    check_quantiles(spark, [float(i % 7) for i in range(500)])


def test_missed_brackets_are_opened(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    bracket = ordering._Bracket("v", 500, 700.0, 800.0)
    ordering._prove(df, [bracket], {"v": (0.0, 999.0)})
    assert bracket.below <= 500 < bracket.below + bracket.inside
    assert ordering._pick(df, [bracket])[id(bracket)] == 500.0


def test_medians_interpolate(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (10, None), (4, 8.0)], "a long, b double")
    assert medians(df, ["a", "b"]) == {"a": 3.0, "b": 2.0}
    assert quartiles(df, ["a"]) == {"a": (2, 3.0, 4)}


def test_rough_quantiles_take_one_pass(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert abs(quantiles(df, {"v": [0.5]}, exact=False)["v"][0] - 500) <= 1


def test_target_rank_is_clamped(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    assert order_statistics(df, [Target("v", 0.5, lambda n: 99)]) == [1.0]


@pytest.mark.parametrize("small", [1, 50, 10**6])
def test_average_ranks(spark, monkeypatch, small):
    monkeypatch.setattr(ordering, "SMALL_BUCKET", small)
    random.seed(3)
    values = [random.randrange(40) for _ in range(200)] + [17] * 100
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values)
    expected = {v: ordered.index(v) + 1 + (ordered.count(v) - 1) / 2 for v in set(values)}
    assert dict(rows(average_ranks(df, ["v"])["v"])) == expected


def test_ranks_of_many_columns_take_as_many_shuffles_as_of_two(spark, monkeypatch):
    """Values of all kinds, beyond double precision, ties, nulls and NaN, against plain counting."""
    monkeypatch.setattr(ordering, "SMALL_BUCKET", 40)
    rng = random.Random(9)
    records = [
        (rng.choice([None, 2**60, 2**60 + 1, rng.randrange(50)]), rng.choice([None, math.nan, 0.5, rng.random()]), rng.randrange(3), Decimal(rng.randrange(20)) / 10, rng.choice("abc"))
        for _ in range(300)
    ]
    df = spark.createDataFrame(records, "a long, b double, c int, d decimal(5,1), e string").repartition(3)

    def ranks(values):
        key = lambda v: (isinstance(v, float) and math.isnan(v), 0.0 if isinstance(v, float) and math.isnan(v) else v)
        ordered = sorted(key(v) for v in values if v is not None)
        return [None if v is None else ordered.index(key(v)) + 1 + (ordered.count(key(v)) - 1) / 2 for v in values]

    wanted = sorted(zip(*[ranks([r[i] for r in records]) for i in range(5)]), key=str)
    assert sorted(map(tuple, with_average_ranks(df, list("abcde")).collect()), key=str) == wanted
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return computed_once(df)

    computed_once = ordering.computed_once
    monkeypatch.setattr(ordering, "computed_once", kept)

    def shuffles(columns):
        plans.clear()
        whole = df.select(*[F.col("c").alias(f"c{i}") for i in range(columns)])
        plans.append(with_average_ranks(whole, whole.columns)._jdf.queryExecution().executedPlan().toString())
        return sum(p.count("Exchange") for p in plans)

    assert shuffles(10) == shuffles(2)


def fill(records, columns):
    held, out = {}, []
    for record in records:
        state = held.setdefault(record["k"], {})
        for c in columns:
            if record[c] is not None:
                state[c] = record[c]
        out.append({**record, **{c: state.get(c) for c in columns}})
    return out


@pytest.mark.parametrize("small", [1, 25, 10**6])
@pytest.mark.parametrize("keyed", [True, False])
def test_forward_fill(spark, monkeypatch, small, keyed):
    """One key holds most rows, and one instant most of those: the second order column cuts it."""
    monkeypatch.setattr(ordering, "SMALL_BUCKET", small)
    random.seed(4)
    start = datetime(2024, 1, 1)
    records = []
    for i in range(300):
        k = "hot" if i % 3 else random.choice("abc")
        when = start if i < 150 else start + timedelta(minutes=i)
        records.append({
            "k": k if keyed else "one", "t": when, "i": i,
            "x": random.choice([None, None, None, i]), "y": random.choice([None, None, f"s{i}"]),
        })
    df = spark.createDataFrame(
        [tuple(r.values()) for r in random.sample(records, len(records))], "k string, t timestamp_ntz, i long, x long, y string"
    ).repartition(5)
    out = forward_fill(df, ["t", "i"], ["k"] if keyed else [], ["x", "y"])
    assert out.columns == df.columns
    got = {r["i"]: (r["x"], r["y"]) for r in out.collect()}
    assert got == {r["i"]: (r["x"], r["y"]) for r in fill(records, ["x", "y"])}


def test_forward_fill_with_null_keys_and_plain_timestamps(spark):
    df = spark.createDataFrame(
        [(None, 1, 5), (None, 2, None), ("a", 3, None)], "k string, i long, v long"
    ).withColumn("t", F.timestamp_seconds("i"))
    out = forward_fill(df, ["t"], ["k"], ["v"])
    assert rows(out, "i", "v") == [(1, 5), (2, 5), (3, None)]
    with pytest.raises(InvalidRequest):
        forward_fill(df, [])
    # Any type that has an order may give it.
    assert rows(forward_fill(df, ["k", "t"], [], ["v"]), "i", "v") == [(1, 5), (2, 5), (3, 5)]
    with pytest.raises(InvalidRequest):
        forward_fill(df.withColumn("m", F.create_map("i", "i")), ["m"])


@pytest.mark.parametrize("small", [1, 30, 10**6])
def test_row_numbers(spark, monkeypatch, small):
    monkeypatch.setattr(ordering, "SMALL_BUCKET", small)
    random.seed(5)
    pairs = [(random.choice([1, 1, 1, 2, 3]), i) for i in range(200)]
    out = row_numbers(spark.createDataFrame(pairs, "a long, b long"), ["a", "b"], "n")
    assert [r[:2] for r in sorted(rows(out), key=lambda r: r[2])] == sorted(pairs)
    assert sorted(r[2] for r in rows(out)) == list(range(1, 201))


def test_close_values_are_not_taken_for_one(spark, monkeypatch):
    """Whole numbers beyond double precision fall together and must still be ordered."""
    monkeypatch.setattr(ordering, "SMALL_BUCKET", 10)
    base = 2**60
    pairs = [(base + i, -i) for i in range(100)] + [(5, i) for i in range(100)]
    out = row_numbers(spark.createDataFrame(pairs, "a long, b long").repartition(3), ["a", "b"], "n")
    assert [r[:2] for r in sorted(rows(out), key=lambda r: r[2])] == sorted(pairs)


def test_instants_are_ordered_in_any_time_zone(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_BUCKET", 5)
    start = datetime(2024, 3, 10, 1, 0)
    times = [start + timedelta(minutes=5 * i, microseconds=i) for i in range(60)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "t timestamp_ntz, i long").repartition(4)
        assert sorted(rows(row_numbers(df, ["t"], "n"), "i", "n")) == [(i, i + 1) for i in range(60)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def mixed_order(n):
    """Rows with null and NaN keys, a heavy first value with texts second, and one heavy pair of both."""
    rng = random.Random(7)
    firsts = [None] * 2 + [math.nan] * 2 + [3.5] * 8 + [float(i) for i in range(8)]
    found = []
    for i in range(n):
        a = rng.choice(firsts)
        b = "same" if a == 3.5 and i % 2 else rng.choice([None, f"t{rng.randrange(n):05d}"])
        found.append((a, b, i, rng.choice([None, None, None, i]), [i] if i % 5 == 0 else None))
    return found


def order_key(r):
    a, b = r[0], r[1]
    return (a is not None, a is not None and math.isnan(a), 0.0 if a is None or math.isnan(a) else a, b is not None, b or "", r[2])


def test_every_kind_of_order_value_is_split_evenly(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_BUCKET", 500)
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 2_000)
    n = 40_000
    records = mixed_order(n)
    df = spark.createDataFrame(records, "a double, b string, i long, x long, l array<long>").repartition(6, "i")
    spread = ordering.with_range_bucket(df, "bucket", ["a", "b"], "place").groupBy("bucket").count()
    sizes = [r["count"] for r in spread.collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * n / 20 and min(sizes) > n / 40
    ordered = sorted(records, key=order_key)
    got = {r["i"]: r["n"] for r in row_numbers(df, ["a", "b", "i"], "n").select("i", "n").collect()}
    assert got == {r[2]: at for at, r in enumerate(ordered, 1)}
    last, wanted = [None, None], {}
    for r in ordered:
        last = [v if v is not None else old for v, old in zip(r[3:], last)]
        wanted[r[2]] = tuple(last)
    filled = forward_fill(df, ["a", "b", "i"], columns=["x", "l"])
    assert {r["i"]: (r["x"], r["l"]) for r in filled.select("i", "x", "l").collect()} == wanted


def test_keys_of_every_kind_are_carried_over_ranges(spark, monkeypatch):
    """Null, NaN, negative zero and nested keys; long runs without a value reach over several ranges."""
    monkeypatch.setattr(ordering, "SMALL_BUCKET", 20)
    rng = random.Random(8)
    keys = [None, math.nan, 0.0, -0.0, 1.0]
    records = [(rng.choice(keys), [rng.choice([1, None])], i, i if rng.random() < 0.02 else None) for i in range(600)]
    df = spark.createDataFrame(records, "k double, l array<long>, i long, v long").repartition(5)
    for columns in (["k"], ["l"], ["k", "l"]):
        last, wanted = {}, {}
        for k, l, i, v in records:
            name = str([k + 0.0 if k is not None else None if "k" in columns else 0, l if "l" in columns else 0] if "k" in columns else l)
            last[name] = v if v is not None else last.get(name)
            wanted[i] = last[name]
        got = {r["i"]: r["v"] for r in forward_fill(df, ["i"], columns, ["v"]).collect()}
        assert got == wanted


def test_row_numbers_and_fill_shuffle_the_rows_once(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return computed_once(df)

    computed_once = ordering.computed_once
    monkeypatch.setattr(ordering, "computed_once", kept)
    df = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") % 9 == 0, F.col("id")).alias("v"))
    for made in (row_numbers(df, ["i"]), forward_fill(df, ["i"])):
        assert "BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 1000
    assert sum("rangepartitioning" in p for p in plans) == 2


def test_a_large_carry_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_BUCKET", 10)
    monkeypatch.setattr(ordering, "BROADCAST_BYTES", 0)
    df = spark.range(200).select(F.col("id").alias("i"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("v"))
    assert rows(forward_fill(df, ["i"]), "i", "v") == [(i, i // 50 * 50) for i in range(200)]


def test_nothing_to_order(spark):
    none = spark.range(0).select(F.col("id").alias("i"), F.lit(1).alias("v"))
    assert row_numbers(none, ["i"]).count() == 0 and forward_fill(none, ["i"]).count() == 0
    assert average_ranks(none, ["i"])["i"].count() == 0


def test_equal_order_values_are_dealt_out(spark, monkeypatch):
    """With one order column and a heavy value the rows of that value may come in any order."""
    monkeypatch.setattr(ordering, "SMALL_BUCKET", 10)
    values = [7] * 150 + list(range(50))
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a long, b long").repartition(3)
    out = sorted(rows(row_numbers(df, ["a"], "n")), key=lambda r: r[2])
    assert [r[0] for r in out] == sorted(values) and [r[2] for r in out] == list(range(1, 201))
    placed = ordering.with_range_bucket(df, "bucket", ["a"]).filter("a = 7")
    assert placed.select("bucket").distinct().count() > 1
