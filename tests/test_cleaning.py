import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tabulon.errors import InvalidRequest
from tabulon.operators.cleaning import (
    CleaningPlan, cell_diff, clean_missing, clean_table, normalize_strings, remove_duplicates, remove_outliers, row_changes,
)


@pytest.fixture(scope="module")
def holed(spark):
    return spark.createDataFrame(
        [("a", 1, 1.0, True), (None, None, None, None), ("c", 5, float("nan"), False)],
        "s string, i long, x double, b boolean",
    )


def test_nan_is_no_hole(holed):
    assert [r["s"] for r in clean_missing(holed, "drop").orderBy("s").collect()] == ["a", "c"]
    filled = clean_missing(holed, "zero").filter("s = 'c'").first()
    assert math.isnan(filled["x"])


def test_fill_strategies(holed):
    def hole(strategy, **options):
        return tuple(clean_missing(holed, strategy, **options).filter("s IS NULL OR s NOT IN ('a', 'c')").first())

    assert hole("fill_zero") == (None, 0, 0.0, None)
    assert hole("unknown") == ("Unknown", 0, 0.0, False)
    assert hole("fill") == ("", 0, 0.0, None)
    assert hole("fill", fill_value="?") == ("?", None, None, None)
    assert hole("fill", fill_value=7) == (None, 7, 7.0, None)
    assert hole("fill", fill_value=True) == (None, None, None, True)
    assert hole("median")[1] == 3.0
    with pytest.raises(InvalidRequest):
        clean_missing(holed, "guess")


def test_fill_mean_widens_whole_numbers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "i int")
    assert rows(clean_missing(df, "mean")) == [(1.0,), (1.5,), (2.0,)]
    empty = spark.createDataFrame([(None,)], "i int")
    assert rows(clean_missing(empty, "mean")) == [(None,)]
    assert rows(clean_missing(empty, "median")) == [(None,)]


def test_instants_are_filled_with_a_given_time(spark):
    df = spark.createDataFrame([(None,)], "t timestamp_ntz")
    now = datetime(2024, 5, 6, 7)
    assert clean_missing(df, "fill", as_of=now).first()[0] == now
    assert clean_missing(df, "fill", now).first()[0] == now


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 2, "y"), (1, 2, "y"), (2, 1, None)], "k long, o long, v string")
    assert remove_duplicates(df).count() == 3
    assert rows(remove_duplicates(df, ["k"], ["o"])) == [(1, 2, "y"), (2, 1, None)]
    assert remove_duplicates(df, ["k"]).count() == 2


def test_text_is_normalised_with_unicode_spaces(spark):
    df = spark.createDataFrame([("  Hello \t\n  ÄWorld ", 1)], "s string, i long")
    assert rows(normalize_strings(df)) == [("hello äworld", 1)]


def test_outliers_one_column_after_the_other(spark):
    data = [(float(i), float(i)) for i in range(1, 20)] + [(1000.0, 5.0), (None, 3.0), (4.0, -500.0)]
    df = spark.createDataFrame(data, "a double, b double")
    kept = remove_outliers(df, ["a", "b"])
    assert kept.agg(F.max("a"), F.min("b"), F.count("*")).first() == (19.0, 1.0, 19)


def test_joint_fences_come_from_the_whole_input(spark):
    rows_in = [(float(i), float(i % 3)) for i in range(50)] + [(500.0, 900.0)] * 12
    df = spark.createDataFrame(rows_in, "a double, b double")

    def fence(values):
        ordered = sorted(values)
        q1, q3 = (ordered[math.floor((len(ordered) - 1) * q + 0.5)] for q in (0.25, 0.75))
        return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)

    def keep(data, at):
        low, high = fence([r[at] for r in data])
        return [r for r in data if low <= r[at] <= high]

    assert rows(remove_outliers(df, ["a", "b"])) == sorted(keep(keep(rows_in, 0), 1))
    joint = [r for r in rows_in if r in keep(rows_in, 0) and r in keep(rows_in, 1)]
    assert rows(remove_outliers(df, ["a", "b"], joint=True)) == sorted(joint)


def test_steps_run_in_order(spark):
    df = spark.createDataFrame([(" A", 1), ("a", 1), ("a", 1), (None, 2)], "s string, i long")
    out, steps = clean_table(df, CleaningPlan(missing="no such strategy"))
    assert steps == ["clean_missing:drop", "remove_duplicates", "normalize_strings"]
    # Rows that become equal only by normalising stay.
    assert rows(out) == [("a", 1), ("a", 1)]
    _, steps = clean_table(df, CleaningPlan(missing=None, duplicates=False, strings=False, outliers=True))
    assert steps == ["remove_outliers"]


def test_clean_sales_are_unchanged(sales):
    out, _ = clean_table(sales)
    assert out.count() == 4


def test_changed_cells_are_found_by_key(spark):
    before = spark.createDataFrame([(1, "A", None), (2, "b", 2.0), (3, "c", 3.0)], "k long, s string, x double")
    after = clean_missing(normalize_strings(before.filter("k < 3")), "zero")
    assert rows(cell_diff(before, after, ["k"])) == [(1, "s", "A", "a"), (1, "x", None, "0.0")]
    assert rows(row_changes(before, after)) == [(3, 2, 1)]
