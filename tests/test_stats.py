import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tabulon.errors import InvalidRequest
from tabulon.operators.patterns import concentrated, missing_pattern, patterns, rare_groups, skew, strong_pairs
from tabulon.operators.stats import anomalies, correlation_matrix, kpis, statistics, top_anomalies, top_correlations


def test_statistics_of_sales(sales):
    got = {r["column"]: r for r in statistics(sales).collect()}
    amount = got["amount"]
    assert amount["mean"] == 187.5 and amount["median"] == 175.0
    assert amount["std"] == pytest.approx(st.stdev([100, 200, 150, 300]))
    assert (amount["q25"], amount["q75"], amount["min"], amount["max"]) == (150.0, 200.0, 100.0, 300.0)
    assert got["region"]["unique"] == 2 and got["region"]["most_common"] == ["East", "West"]
    assert [r["column"] for r in statistics(sales, ["qty"]).collect()] == ["qty"]


def test_statistics_of_nothing(spark):
    got = statistics(spark.createDataFrame([(None, None)], "x double, s string")).orderBy("position").collect()
    assert (got[0]["count"], got[0]["missing"], got[0]["mean"], got[0]["median"], got[0]["q25"]) == (1, 1, None, None, None)
    assert (got[1]["unique"], got[1]["most_common"]) == (1, None)


def test_rough_statistics_agree_on_small_tables(sales):
    exact = statistics(sales, ["amount"]).first()
    rough = statistics(sales, ["amount"], exact=False).first()
    assert rough["mean"] == exact["mean"] and rough["q75"] == exact["q75"]


def test_kpis(sales):
    out = {r["kpi"]: (r["agg"], r["value"], r["error"]) for r in kpis(
        sales, {"amount": "sum", "qty": {"agg": "nonsense"}, "name": "sum", "nope": {}}
    ).collect()}
    assert out == {
        "amount": ("sum", 750.0, None), "qty": ("nonsense", 75.0, None),
        "name": (None, None, "column is not numeric"), "nope": (None, None, "column not found"),
    }


def test_pearson(sales):
    got = {(r["a"], r["b"]): r["corr"] for r in correlation_matrix(sales).collect()}
    assert got[("amount", "amount")] == 1.0 and got[("amount", "qty")] == got[("qty", "amount")] == 1.0


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    got = {(r["a"], r["b"]): r["corr"] for r in correlation_matrix(df).collect()}
    assert got[("a", "b")] is None and got[("b", "b")] is None and got[("a", "a")] == 1.0
    assert correlation_matrix(df.select("a")).count() == 0
    with pytest.raises(InvalidRequest):
        correlation_matrix(df, "kendall")


def ranks(values):
    ordered = sorted(values)
    return [ordered.index(v) + 1 + (ordered.count(v) - 1) / 2 for v in values]


def test_spearman_with_ties_and_holes(spark):
    random.seed(6)
    data = [(random.randrange(6), random.random() if random.random() > 0.1 else None) for _ in range(300)]
    df = spark.createDataFrame(data, "a long, b double").repartition(5)
    whole = [d for d in data if d[1] is not None]
    expected = st.correlation(ranks([d[0] for d in whole]), ranks([d[1] for d in whole]))
    got = {(r["a"], r["b"]): r["corr"] for r in correlation_matrix(df, "spearman").collect()}
    assert got[("a", "b")] == pytest.approx(expected, abs=1e-6)


def test_pairs_use_the_rows_they_have(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, None, 0.5), (4.0, 8.0, 0.1)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["corr"] for r in top_correlations(df).collect()}
    assert got[("a", "b")] == 1.0
    assert got[("a", "c")] == pytest.approx(st.correlation([2, 3, 4], [1, 0.5, 0.1]), abs=1e-4)


def test_anomalies_reach_the_threshold(spark):
    values = [float(v) for v in range(1, 20)] + [100.0, None]
    df = spark.createDataFrame([(v, 1.0) for v in values], "v double, flat double")
    found = anomalies(df, ["v", "flat"], 0.05)
    assert [(r["v"], r["z_flat"]) for r in found.orderBy("v").collect()] == [(1.0, 0.0), (100.0, 0.0)][-found.count():]
    best = top_anomalies(df, ["v"], 0.1, limit=1).first()
    assert best["v"] == 100.0 and best["anomaly_count"] >= 1
    with pytest.raises(InvalidRequest):
        anomalies(df.selectExpr("'x' AS s"), ["s"])


def test_all_flat_columns_score_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert rows(anomalies(df, ["v"]), "score") == [(0.0,), (0.0,)]
    assert anomalies(df.filter("v > 9"), ["v"]).count() == 0


def test_skew_needs_ten_rows(spark):
    df = spark.createDataFrame([(0.0,)] * 9 + [(1.0,)] * 4, "v double")
    assert rows(skew(df)) == [("skew", "v", pytest.approx(round((4 / 13) / st.stdev([0.0] * 9 + [1.0] * 4), 3)))]
    assert rows(skew(df.limit(9))) == []


def test_strong_pairs(spark):
    df = spark.createDataFrame([(float(i), float(i * i), float((-1) ** i)) for i in range(12)], "a double, b double, c double")
    assert [r[1] for r in rows(strong_pairs(df))] == ["a ~ b"]
    assert rows(strong_pairs(df.limit(5))) == []


def test_rare_and_concentrated_groups(spark):
    df = spark.createDataFrame([("big",)] * 196 + [("a",), ("b",), ("c",), ("d",), (None,)], "g string")
    assert rows(rare_groups(df, "g")) == [("rare", "g=a", 0.5), ("rare", "g=b", 0.5), ("rare", "g=c", 0.5)]
    assert rows(concentrated(df, "g")) == [("concentration", "g", round((196**2 + 4) / 201**2, 3))]
    assert rows(rare_groups(df.filter("g IN ('a', 'b')"), "g")) == []


def test_patterns_strongest_first(spark):
    df = spark.createDataFrame([("x", None if i < 4 else float(i), float(i)) for i in range(20)], "g string, a double, b double")
    out = patterns(df, "g").collect()
    assert [r["kind"] for r in out] == ["missing", "correlation"]
    assert rows(missing_pattern(df)) == [("missing", "a", 20.0)]


def test_statistics_of_many_columns_take_three_passes(spark):
    """Counted where the rows are made: as many passes for eight columns as for one."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def passes(columns):
        made = spark.range(2000).select(*[((F.col("id") * (7 + i)) % 1999).cast("double").alias(f"c{i}") for i in range(columns)])
        seen.value = 0
        found = statistics(made.mapInArrow(counted, made.schema)).collect()
        assert len(found) == columns and all(r["median"] is not None and r["mean"] is not None for r in found)
        return seen.value / 2000

    assert passes(1) == passes(8) == 3
