import pytest
from pyspark.sql import functions as F

from conftest import rows
from tabulon.errors import InvalidRequest
from tabulon.operators.explore import (
    chart_series, grouped, page, query_counts, result_limits, run_plan, run_query, sort_rows,
)
from tabulon.operators.samples import head_sample
from tabulon.plans.specs import EXPLORE_LIMIT, Plan, QuerySpec


def test_empty_sum_is_zero_and_null_is_a_value(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1), ("b", None), (None, 2)], "k string, v long")
    out = grouped(df, ["k"], [{"column": "v"}, {"column": "v", "agg": "n_unique"}, {"column": "v", "agg": "count"}])
    assert rows(out) == [(None, 2, 1, 1), ("a", 0, 1, 0), ("b", 1, 2, 1)]


def test_default_is_a_count(sales):
    assert rows(grouped(sales, ["region"])) == [("East", 2), ("West", 2)]


def test_wrong_specs(sales):
    for keys, aggs in ((([]), None), (["nope"], None), (["region"], [{"column": "name", "agg": "sum"}]),
                       (["region"], [{"column": "amount", "agg": "median"}]), (["region"], [{"column": "nope"}])):
        with pytest.raises(InvalidRequest):
            grouped(sales, keys, aggs)


def test_plan_group_sorts_by_alias(spark):
    df = spark.createDataFrame([("ash", 3.5), ("oak", 1.0), ("elm", 9.0), ("oak", 4.0), ("elm", -2.0)], "tree string, height double")
    plan = {"group_by": ["tree"], "aggregations": [{"column": "height", "agg": "max", "alias": "tallest"}], "sort_by": "tallest"}
    assert [tuple(r) for r in run_plan(df, plan).collect()] == [("elm", 9.0), ("oak", 4.0), ("ash", 3.5)]


def test_plan_without_group_has_one_row(sales):
    out = run_plan(sales, {"aggregations": [{"column": "amount", "agg": "mean"}]})
    assert out.columns == ["mean_amount"] and rows(out) == [(187.5,)]


def test_plan_groups_alone_are_counted(sales):
    assert rows(run_plan(sales, {"group_by": ["region"]})) == [("East", 2), ("West", 2)]


def test_plan_sorts_nulls_first_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "v long")
    for direction in ("asc", "desc"):
        assert run_plan(df, {"sort_by": "v", "sort_dir": direction}).first()[0] is None


def test_plan_limits():
    for bad in (0, 201):
        with pytest.raises(InvalidRequest):
            Plan(limit=bad)


def test_sort_puts_nulls_last_and_ignores_unknown_columns(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "v long").coalesce(1)
    for direction in ("asc", "desc"):
        assert sort_rows(df, "v", direction).collect()[-1][0] is None
    assert sort_rows(df, "nope").count() == 3


def test_saved_view_round_trip(sales):
    spec = QuerySpec(
        mode="grouped", filters=[{"column": "qty", "op": "between", "value": [10, 20]}], group_by=["region"],
        aggregations=[{"column": "amount", "agg": "max"}], sort_by="amount__max", sort_dir="desc", limit=1,
    )
    again = QuerySpec.from_json(spec.to_json())
    assert again == spec
    assert rows(run_query(sales, again)) == [("West", 200)]


def test_limits_are_honoured_or_refused(spark):
    df = spark.range(3000)
    assert run_query(df, QuerySpec(limit=99_999)).count() == df.count()
    for limit in (99_999, -5):
        with pytest.raises(InvalidRequest):
            run_query(df, QuerySpec(limit=limit), EXPLORE_LIMIT)
    assert run_query(df, QuerySpec()).count() == 3000


def test_offset_pages_do_not_overlap(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id"))
    pages = [run_query(df, QuerySpec(sort_by="k", limit=30, offset=o)).collect() for o in (0, 30, 60, 90)]
    assert sorted(r["id"] for p in pages for r in p) == list(range(100))
    with pytest.raises(InvalidRequest):
        page(df, 0, 10, [])


def test_counts_of_a_query(sales):
    spec = QuerySpec(mode="grouped", filters=[{"column": "amount", "op": "gt", "value": 100}], group_by=["region"])
    assert rows(query_counts(sales, spec)) == [(4, 3, 2)]
    assert rows(query_counts(sales, QuerySpec(filters=spec.filters, limit=1))) == [(4, 3, 3)]
    assert rows(query_counts(sales.limit(0), QuerySpec())) == [(0, 0, 0)]


def test_result_limits(spark):
    assert rows(result_limits(spark.range(15_000), "grouped", 200)) == [(15_000, 200, True, True)]
    assert rows(result_limits(spark.range(15_000), "raw", 200)) == [(15_000, 200, True, False)]
    assert rows(result_limits(spark.range(500), "grouped", 1000)) == [(500, 500, False, False)]


def test_chart_resolves_aggregates_and_fills_gaps(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None)], "g string, v__sum double")
    out = chart_series(df, "g", "v", [F.asc("g")])
    assert [tuple(r) for r in out.collect()] == [("a", 2.0), ("b", 0.0)]


def test_head_sample(spark):
    assert [head_sample(spark.range(1000), n).count() for n in (1, 20, 999)] == [1, 20, 999]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("b"))
    samples = [sorted(map(str, head_sample(df.repartition(n, "b"), 25).collect())) for n in (1, 3, 8)]
    assert samples[0] == samples[1] == samples[2] and len(samples[0]) == 25
    same = spark.range(90).select(F.lit(1).alias("a"))
    assert head_sample(same, 7).count() == 7 and head_sample(df.limit(0), 5).count() == 0
