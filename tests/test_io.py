import json
from datetime import datetime

import pytest

from conftest import rows
from tabulon.errors import EmptyInput, InvalidRequest
from tabulon.operators.explore import run_plan
from tabulon.operators.report import build_report
from tabulon.plans.specs import Plan, QuerySpec
from tabulon.sources.readers import (
    content_duplicates, drop_content_duplicates, file_hashes, read_csv, read_json, read_table,
)
from tabulon.sources.writers import (
    log_query, save_derived, upsert, upsert_counts, write_csv, write_query_json, write_tables,
)


def test_csv_keeps_dates_as_text_and_bad_cells_as_null(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("d,t,n\n2024-01-01,2024-01-01 10:00:00,1\n2024-01-02,x,2\n")
    plain = read_csv(spark, str(path))
    assert dict(plain.dtypes) == {"d": "string", "t": "string", "n": "int"}
    assert rows(plain, "d") == [("2024-01-01",), ("2024-01-02",)]
    assert dict(read_csv(spark, str(path), dates_as_strings=False).dtypes)["d"] == "date"
    path.write_text("n,s\n1,a\nbad,b\n")
    assert rows(read_csv(spark, str(path), schema="n int, s string")) == [(None, "b"), (1, "a")]


def test_suffix_decides(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert rows(read_table(spark, str(tmp_path / "t.tsv"))) == [(1, "x")]
    (tmp_path / "t.json").write_text('[{"a": 1}, {"a": 2}]')
    assert read_table(spark, str(tmp_path / "t.json"), json_mode="array").count() == 2
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert rows(read_json(spark, str(tmp_path / "l.json"), schema="a long")) == [(1,), (2,)]
    for bad in ("t.xlsx", "t"):
        with pytest.raises(InvalidRequest):
            read_table(spark, bad)
    with pytest.raises(InvalidRequest):
        read_json(spark, "x.json", json_mode="guess")


def test_csv_round_trip(spark, tmp_path):
    cells = ["a,b", None, 'say "x"', '"', 'a "b", c', "two\nlines", '"x"\n,', " kept ", "back\\slash", '\\"']
    df = spark.createDataFrame(list(zip(cells, range(len(cells)))), "s string, i long")
    path = str(tmp_path / "out.csv")
    write_csv(df, path)
    assert rows(read_csv(spark, path, schema="s string, i long")) == rows(df)


def test_standard_quoting_is_read(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"say ""hi"" now",1\n"a ""b"", c",2\n"two\nlines",3\nplain,4\n')
    assert rows(read_csv(spark, str(path))) == sorted([('say "hi" now', 1), ('a "b", c', 2), ("two\nlines", 3), ("plain", 4)])


def test_json_in_either_form(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n  [{"a": 1},\n {"a": 2}]')
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n')
    for name in ("a.json", "l.json"):
        assert rows(read_json(spark, str(tmp_path / name))) == [(1,), (2,)]


def test_equal_content(spark, tmp_path):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, None)], "id long, t string")
    out = content_duplicates(df, "id", "t")
    assert rows(out, "id", "first_id", "copies", "is_duplicate") == [
        (1, 1, 2, False), (2, 2, 1, False), (3, 1, 2, True), (4, 4, 1, False), (5, 5, 1, False),
    ]
    assert rows(drop_content_duplicates(df, "id", "t"), "id") == [(1,), (2,), (4,), (5,)]
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.bin").write_bytes(b"same" if name != "c" else b"other")
    hashes = file_hashes(spark, str(tmp_path))
    assert hashes.count() == 3 and hashes.select("content_hash").distinct().count() == 2


def test_query_as_json_with_counts(spark, sales, tmp_path):
    path = str(tmp_path / "q")
    spec = QuerySpec(filters=[{"column": "amount", "op": "gte", "value": 150}], columns=["name"])
    meta = write_query_json(sales, spec, path)
    assert (meta["source_rows"], meta["filtered_rows"], meta["total_rows"], meta["columns"]) == (4, 3, 3, ["name"])
    assert json.loads(spark.read.text(f"{path}/meta").first()[0]) == meta
    assert rows(spark.read.json(f"{path}/rows")) == [("Beta",), ("Delta",), ("Gamma",)]


def test_derived_table_keeps_its_origin(spark, sales, tmp_path):
    path = str(tmp_path / "d")
    lineage = save_derived(sales, path, "join", ["a", "b"], ["inner"], 9)
    assert lineage["rows_after"] == 4
    assert spark.read.json(f"{path}/lineage").first()["rows_before"] == 9
    assert spark.read.parquet(f"{path}/data").count() == 4
    with pytest.raises(EmptyInput):
        save_derived(sales.limit(0), str(tmp_path / "e"), "etl", [])
    assert not (tmp_path / "e").exists()


def test_report_and_log(spark, sales, tmp_path):
    write_tables(build_report(sales), str(tmp_path / "r"))
    sections = {r[0] for r in spark.read.json(str(tmp_path / "r")).select("section").distinct().collect()}
    assert {"overview", "statistics", "groups"} <= sections
    plan = Plan(group_by=["region"])
    for _ in range(2):
        log_query(run_plan(sales, plan), "how many?", plan, str(tmp_path / "log"), datetime(2024, 1, 1))
    logged = spark.read.json(str(tmp_path / "log"))
    first = logged.first()
    assert logged.count() == 2 and first["row_count"] == 2 and len(first["sample_rows"]) == 2
    assert json.loads(first["plan"])["group_by"] == ["region"]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    source = spark.createDataFrame([("B", 2), ("C", 3)], "v string, id long")
    assert rows(upsert(target, source, ["id"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(upsert_counts(target, source, ["id"])) == [(1, 1)]
    with pytest.raises(InvalidRequest):
        upsert(target, source, ["nope"])
    with pytest.raises(Exception, match="twice"):
        upsert(target, source.unionAll(source), ["id"]).collect()


def test_repeated_ids_keep_only_the_first_of_each_content(spark):
    """An id that is the first of one content keeps no copy of another one."""
    df = spark.createDataFrame([(1, "x"), (1, "y"), (0, "y"), (2, "x"), (3, None), (0, "z")], "id long, text string")
    kept = sorted(map(tuple, drop_content_duplicates(df, "id", "text").collect()), key=str)
    assert kept == sorted([(1, "x"), (0, "y"), (0, "z"), (3, None)], key=str)
