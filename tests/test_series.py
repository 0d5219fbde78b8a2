from datetime import date

import pytest
from pyspark.errors import PySparkException

from conftest import rows
from tabulon.errors import InvalidRequest
from tabulon.functions.temporal import parse_boundary
from tabulon.operators.charts import histogram, scatter_points
from tabulon.operators.series import (
    compare_periods, concentration, forecast, forecast_by_key, pareto, pareto_summary, timeseries,
)


@pytest.fixture(scope="module")
def two_months(spark):
    return spark.createDataFrame(
        [("2024-01-05", 100, 10), ("2024-01-20", 200, 20), ("2024-02-05", 150, 15), ("2024-02-20", 300, 30)],
        "date string, amount long, qty long",
    )


def test_daily_series_of_text_dates(dated):
    out = timeseries(dated, "date", ["amount"]).collect()
    assert [tuple(r) for r in out] == [
        ("2024-01-01", 100, None), ("2024-01-02", 200, 100.0), ("2024-01-03", 150, -25.0), ("2024-01-10", 300, 100.0),
    ]


def test_weeks_start_on_monday(dated):
    out = timeseries(dated, "date", ["amount"], "week", "mean").collect()
    assert [tuple(r) for r in out] == [("2024-01-01", 150.0, None), ("2024-01-08", 300.0, 100.0)]


def test_months_and_bad_dates(spark):
    df = spark.createDataFrame([("2024-01-31", 0), ("2024-02-01 10:00:00", 5), ("never", 9), (None, 9)], "d string, v long")
    out = timeseries(df, "d", ["v"], "month", "max").collect()
    assert [tuple(r) for r in out] == [("2024-01-01", 0, None), ("2024-02-01", 5, None)]


def test_all_periods_or_the_earliest(spark):
    df = spark.range(40).selectExpr("date_add(DATE'2024-01-01', CAST(id AS INT)) AS d", "id AS v")
    assert timeseries(df, "d", ["v"]).count() == 40
    out = timeseries(df, "d", ["v"], limit=3).collect()
    assert [r["period"] for r in out] == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_series_refusals(dated):
    for bad in ({"granularity": "year"}, {"agg": "median"}, {"metrics": ["region"]}, {"date_column": "amount"}):
        arguments = {"date_column": "date", "metrics": ["amount"], **bad}
        with pytest.raises(InvalidRequest):
            timeseries(dated, **arguments)


def test_compare_january_with_february(two_months):
    out = {(r["column"], r["stat"]): tuple(r)[2:] for r in compare_periods(
        two_months, "date", ("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-29")
    ).collect()}
    assert out[("amount", "sum")] == (300.0, 450.0, 150.0, 50.0)
    assert out[("amount", "count")] == (2.0, 2.0, 0.0, None)
    assert out[("qty", "mean")] == (15.0, 22.5, 7.5, 50.0)


def test_periods_in_any_order_and_overlapping(two_months):
    swapped = compare_periods(two_months, "date", ("2024-02-01", "2024-02-29"), ("2024-01-01", "2024-02-10"), ["amount"])
    sums = {r["stat"]: (r["period_a"], r["period_b"]) for r in swapped.collect()}
    assert sums["sum"] == (450.0, 450.0) and sums["count"] == (2.0, 3.0)


def test_empty_period_is_an_error(two_months):
    with pytest.raises(PySparkException, match="a period has no rows"):
        compare_periods(two_months, "date", ("2020-01-01", "2020-12-31"), ("2024-01-01", "2024-02-29")).collect()


def test_boundaries():
    assert parse_boundary("2024-01-31", end_of_day=True).microsecond == 999_999
    assert parse_boundary(date(2024, 1, 31)).hour == 0
    for bad in ("", None, "soon"):
        with pytest.raises(InvalidRequest):
            parse_boundary(bad)


def test_forecast(dated):
    out = forecast(dated, "date", "amount", 2).collect()
    drift = (300 - 100) / 3
    assert [r["yhat"] for r in out] == [round(187.5 + drift, 4), round(187.5 + 2 * drift, 4)]
    assert out[0]["baseline_mean"] == 187.5 and out[0]["last_date"] == "2024-01-10"


def test_forecast_uses_the_last_seven_rows(spark):
    df = spark.range(20).selectExpr("id AS d", "CAST(id * id AS DOUBLE) AS v").withColumnRenamed("d", "when")
    out = forecast(df, "when", "v", 1).first()
    assert out["yhat"] == round(sum(i * i for i in range(13, 20)) / 7 + 361 / 19, 4)


def test_forecast_needs_two_rows(dated):
    with pytest.raises(PySparkException, match="two rows"):
        forecast(dated.limit(1), "date", "amount").collect()


def test_forecast_per_series(dated):
    keyed = {r["region"]: r["yhat"] for r in forecast_by_key(dated, ["region"], "date", "amount", 1).collect()}
    assert keyed == {"East": 175.0, "West": 350.0}
    assert forecast_by_key(dated.filter("amount = 100"), ["region"], "date", "amount").count() == 0


def test_pareto(sales):
    out = pareto(sales, ["name"], "amount").collect()
    assert [(r["name"], r["share_pct"], r["cum_share_pct"]) for r in out] == [
        ("Delta", 40.0, 40.0), ("Beta", 26.67, 66.67), ("Gamma", 20.0, 86.67), ("Alpha", 13.33, 100.0),
    ]
    summary = pareto_summary(sales, ["name"], "amount").first()
    assert (summary["groups"], summary["total"], summary["groups_to_80"]) == (4, 750.0, 3)
    assert summary["hhi"] == round((100**2 + 200**2 + 150**2 + 300**2) / 750**2, 4)


def test_pareto_of_zeros_and_nulls(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", None)], "g string, v double")
    assert [(r["g"], r["share_pct"]) for r in pareto(df, ["g"], "v").collect()] == [("a", 0.0)]
    assert pareto(df, ["g"], "v", "count").count() == 2
    assert pareto_summary(df, ["g"], "v").first()["hhi"] == 0.0
    with pytest.raises(InvalidRequest):
        pareto(df, [], "v")


def test_groups_to_the_mark_come_from_all_groups(spark):
    df = spark.range(500).selectExpr("id AS g", "1.0D AS v")
    assert pareto_summary(df, ["g"], "v").first()["groups_to_80"] == 400
    assert pareto(df, ["g"], "v", top_n=150).count() == 150


def test_concentration_of_row_counts(sales):
    assert rows(concentration(sales, "region")) == [(2, 0.5)]


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (12.0,), (None,)], "v double")
    out = [r["n"] for r in histogram(df, "v").orderBy("bin").collect()]
    assert out == [1, 1] + [0] * 9 + [1]
    flat = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [tuple(r) for r in histogram(flat, "v").orderBy("bin").limit(1).collect()] == [(0, 5.0, 5.08, 2)]
    assert histogram(df.filter("v > 99"), "v").count() == 0
    odd = spark.createDataFrame([(0.0,), (12.0,), (float("nan"),), (float("inf"),)], "v double")
    assert [r["n"] for r in histogram(odd, "v").orderBy("bin").collect()] == [1] + [0] * 10 + [1]


def test_scatter_skips_holes(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0), (3, 3.0, 6.0)], "i long, x double, y double")
    assert rows(scatter_points(df, "x", "y")) == [(2.0, 5.0), (3.0, 6.0)]
    many = spark.range(1000).selectExpr("id AS x", "id AS y")
    sample = rows(scatter_points(many, "x", "y", 100))
    assert len(sample) == 100 and max(sample)[0] > 500 and sample == rows(scatter_points(many.repartition(3), "x", "y", 100))
