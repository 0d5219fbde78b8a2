import json

import pytest

from conftest import rows
from tabulon.errors import InvalidRequest
from tabulon.operators.report import (
    build_report, context_summary, default_group, describe_filters, grouped_table, leaders, long_form, top_tables,
)


def test_filters_apply_before_all_tables(sales):
    tables = build_report(sales, filters=[{"column": "amount", "op": "between", "value": [100, 200]}])
    overview = dict(rows(tables["overview"]))
    assert (overview["source_rows"], overview["filtered_rows"]) == ("4", "3")
    assert overview["filters"] == "amount between [100, 200]"
    smallest = tables["statistics"].filter("column = 'amount'").first()
    assert (smallest["count"], smallest["min"]) == (3, 100.0)


def test_kinds_of_report(sales):
    assert "correlations" not in build_report(sales, "summary")
    assert "correlations" in build_report(sales, "executive")
    full = build_report(sales, "full", ["region"], ["amount"])
    assert {"correlations", "anomalies", "histogram", "groups", "top_groups", "leaders", "patterns"} <= set(full)
    assert full["anomalies"].first()["amount"] == 300
    with pytest.raises(InvalidRequest):
        build_report(sales, "poster")
    with pytest.raises(InvalidRequest):
        build_report(sales, group_by=["nope"])


def test_defaults(sales, spark):
    assert default_group(sales) == "name"
    assert default_group(spark.range(1)) == "id"
    assert dict(rows(build_report(sales)["overview"]))["metrics"] == "amount, qty"


def test_groups_share_all_rows(spark):
    df = spark.createDataFrame([("a", 1.0)] * 6 + [("b", 5.0)] * 3 + [(None, None)], "g string, v double")
    out = grouped_table(df, ["g"], ["v"]).collect()
    assert [(r["g"], r["count"], r["share_pct"], r["v__sum"]) for r in out] == [
        ("a", 6, 60.0, 6.0), ("b", 3, 30.0, 15.0), (None, 1, 10.0, 0.0),
    ]
    assert [(r["rank"], r["g"]) for r in top_tables(df, ["g"], ["v"], 3).orderBy("rank").collect()] == [(1, "b"), (2, "a"), (3, None)]
    assert rows(leaders(df, ["g"], ["v"])) == [
        ("largest_group", "a", 6.0, 60.0), ("top_three_share", "", 10.0, 100.0), ("top_v", "b", 15.0, None),
    ]


def test_long_form_numbers_rows(sales):
    out = long_form("sales", sales.select("name", "qty"), ["name"])
    assert rows(out.filter("row = 1"), "section", "column", "value") == [("sales", "name", "Alpha"), ("sales", "qty", "10")]


def test_describe_filters():
    assert describe_filters([{"column": "a", "op": "is_null", "value": 3}, {"column": "b", "value": 1}]) == "a is_null; b eq 1"


def test_summary_covers_all_rows(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id % 2 AS STRING) AS g", "id * 2.0D AS twice", "repeat('x', 100) AS long")
    out = context_summary(df, ["g"], [{"column": "id", "agg": "max"}], ["id"]).collect()
    stats = {r["item"]: json.loads(r["payload"]) for r in out if r["section"] == "column_stats"}
    assert stats["id"]["count"] == 5000 and stats["id"]["max"] == 4999.0
    assert [json.loads(r["payload"])["id__max"] for r in out if r["section"] == "group"] == [4998, 4999]
    assert [r["item"] for r in out if r["section"] == "correlation"] == ["id ~ twice"]
    samples = [json.loads(r["payload"]) for r in out if r["section"] == "sample_row"]
    assert len(samples) == 6 and samples[0]["long"] == "x" * 79 + "…"
