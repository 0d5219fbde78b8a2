import pytest

from conftest import rows
from tabulon.errors import InvalidRequest
from tabulon.functions.schema import columns_meta
from tabulon.operators.profile import (
    distinct_values, duplicate_rows, missing_counts, modes, profile, profile_insights, quality, quality_issues, top_values,
)


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [("x", 1, 1.0, "2024-01-01"), ("x", 1, 1.0, "2024-01-01"), ("y", None, 0.0, "2024-01-03"), (None, 3, -0.0, "2024-01-04")],
        "s string, i long, f double, d string",
    ).selectExpr("s", "i", "f", "CAST(d AS date) AS d")


def test_quality(mixed):
    assert rows(quality(mixed)) == [(4, 4, 2, 1, 0.875, 0.75)]
    assert rows(quality_issues(mixed)) == [("i", 1, 0.25), ("s", 1, 0.25)]
    assert rows(duplicate_rows(mixed)) == [(4, 1)]


def test_quality_of_clean_and_empty_tables(sales, spark):
    assert rows(quality(sales)) == [(4, 4, 0, 0, 1.0, 1.0)]
    empty = spark.createDataFrame([], "a long")
    assert rows(quality(empty)) == [(0, 1, 0, 0, 1.0, 1.0)]
    assert rows(quality_issues(empty)) == []


def test_profile(mixed):
    got = {r["column"]: r for r in profile(mixed).collect()}
    assert (got["s"]["kind"], got["s"]["missing"], got["s"]["missing_pct"], got["s"]["unique"]) == ("string", 1, 25.0, 3)
    assert (got["i"]["min"], got["i"]["max"], got["i"]["unique"]) == ("1", "3", 3)
    assert got["f"]["unique"] == 2  # the two zeros are one value
    assert (got["d"]["kind"], got["d"]["min"], got["d"]["max"]) == ("datetime", "2024-01-01", "2024-01-04")
    rough = {r["column"]: r["unique"] for r in profile(mixed, exact=False).collect()}
    assert rough == {c: got[c]["unique"] for c in got}


def test_profile_of_sales(sales):
    out = profile(sales).collect()
    assert len(out) == 4 and sum(r["missing"] for r in out) == 0


def test_insights(mixed):
    found = {r["rule"]: (r["column"], r["value"]) for r in profile_insights(mixed).collect()}
    assert found["rows"] == (None, 4.0)
    assert found["completeness"] == (None, 0.875)
    assert found["duplicate_rows"] == (None, 1.0)
    assert found["category"] == ("s", 3.0)
    assert found["numeric_columns"] == (None, 2.0)
    assert found["date_span_days"] == ("d", 3.0)


def test_common_values(mixed):
    assert rows(top_values(mixed, ["s"], 1)) == [("s", "x", 2, 1)]
    assert rows(modes(mixed, ["s", "d"])) == [("d", "2024-01-01", 2), ("s", "x", 2)]


def test_all_tied_modes_are_kept(spark):
    df = spark.createDataFrame([(v,) for v in "hgfedcba"], "v string")
    assert [r[1] for r in rows(modes(df, ["v"]))] == list("abcdefgh")
    assert [r[1] for r in rows(modes(df, ["v"], 5))] == list("abcde")


def test_column_values(sales):
    assert rows(distinct_values(sales, "region")) == [("East", 2, False), ("West", 2, False)]
    assert rows(distinct_values(sales, "region", "eas")) == [("East", 1, False)]
    assert rows(distinct_values(sales, "name", limit=1)) == [("Alpha", 4, True)]
    with pytest.raises(InvalidRequest):
        distinct_values(sales, "nope")


def test_columns_meta(mixed):
    assert [(r["name"], r["kind"]) for r in columns_meta(mixed).collect()] == [
        ("s", "string"), ("i", "number"), ("f", "number"), ("d", "datetime"),
    ]


def test_missing_counts_need_known_columns(mixed):
    with pytest.raises(InvalidRequest):
        missing_counts(mixed, ["nope"])


def test_long_texts_are_told_apart(spark):
    long = "x" * 100
    df = spark.createDataFrame([(long,), (long,), (long + "y",), ("x",), (None,)], "t string")
    assert profile(df).first()["unique"] == 4
    assert rows(duplicate_rows(df)) == [(5, 1)]
