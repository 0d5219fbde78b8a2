import pytest

from conftest import rows
from tabulon.errors import InvalidRequest
from tabulon.plans.sqlguard import check_select, run_select


def test_select_over_named_tables(spark, sales):
    out = run_select(spark, "SELECT region, sum(amount) AS total FROM s GROUP BY region ORDER BY total DESC;", {"s": sales})
    assert [tuple(r) for r in out.collect()] == [("West", 500), ("East", 250)]


def test_with_and_joins(spark, sales):
    text = "WITH big AS (SELECT * FROM s WHERE amount > 100) SELECT count(*) AS n FROM big JOIN t ON big.name = t.name"
    assert rows(run_select(spark, text, {"s": sales, "t": sales})) == [(3,)]


@pytest.mark.parametrize("text", [
    "DROP TABLE s", "  insert into s values (1)", "SELECT 1; SELECT 2", "", "EXPLAIN SELECT 1",
    "WITH x AS (SELECT 1) INSERT INTO s SELECT * FROM x", "SELECT * FROM s -- ok\n; DROP TABLE s",
    "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT java_method('a', 'b')",
    "SELECT * FROM parquet.`/etc`", "SELECT * FROM other", "SELECT * FROM s, `other`", "SELECT * FROM s JOIN secret ON true",
])
def test_refused(spark, text):
    with pytest.raises(InvalidRequest):
        check_select(text, ["s"])


def test_words_inside_literals_are_fine(spark, sales):
    out = run_select(spark, "SELECT name, 'drop {it}' AS note, \"it's; delete\" AS more FROM s /* drop */ LIMIT 1", {"s": sales})
    assert out.first()["note"] == "drop {it}"


@pytest.mark.parametrize("text", ["SELECT 1) UNION ALL (SELECT 2", "SELECT 1), (SELECT 2", "SELECT (1"])
def test_text_cannot_leave_the_subquery(spark, text):
    with pytest.raises(InvalidRequest):
        check_select(text, ["s"])


def test_listed_tables_and_from_in_functions(spark, sales):
    out = run_select(
        spark, "SELECT extract(YEAR FROM d) AS y, trim(BOTH 'x' FROM a.name) AS n FROM s a, t AS b WHERE a.name = b.name",
        {"s": sales.selectExpr("name", "DATE'2024-01-01' AS d"), "t": sales},
    )
    assert out.first()["y"] == 2024 and out.count() == 4
    with pytest.raises(InvalidRequest):
        check_select("SELECT * FROM s a, secret b", ["s"])


@pytest.mark.parametrize("text", [
    "SELECT * FROM s JOIN t ON s.name = t.name, secret", "SELECT name FROM s UNION ALL TABLE secret", "SELECT `reflect`('a', 'b')",
    "FROM s, (SELECT 1) y, secret", "SELECT * FROM s AS x(a, b), secret", "SELECT * FROM (secret)", "SELECT * FROM s TABLESAMPLE (10 ROWS), secret",
    "SELECT * FROM IDENTIFIER('secret')", "SELECT (SELECT max(a) FROM secret)", "SELECT 1 WHERE 1 IN (SELECT a FROM secret)",
    "SELECT * FROM (WITH secret AS (SELECT 1) SELECT * FROM secret) a, secret", "SELECT * FROM s, LATERAL (SELECT * FROM secret)",
    "SELECT * FROM s LATERAL VIEW `java_method`('a', 'b') e", "SELECT TRANSFORM(name) USING 'cat' FROM s", "SELECT * FROM sql_keywords()",
    "SELECT builtin.reflect('a', 'b')", "FROM secret |> SELECT *", "SELECT * FROM s ORDER BY (SELECT a FROM secret)",
])
def test_no_way_around_the_guard(spark, text):
    with pytest.raises(InvalidRequest):
        check_select(text, ["s", "t"])


def test_columns_may_be_called_anything(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "load int, add int, `set` int, use int")
    assert run_select(spark, "SELECT load + add + `set` + use AS drop FROM s", {"s": df}).first()["drop"] == 10


def test_limit_is_honoured_and_views_do_not_stay(spark):
    big = spark.range(5000)
    assert run_select(spark, "SELECT * FROM big", {"big": big}).count() == 5000
    assert run_select(spark, "SELECT * FROM big", {"big": big}, 3000).count() == 3000
    with pytest.raises(InvalidRequest):
        run_select(spark, "SELECT * FROM big", {"big": big}, -1)
    assert "big" not in [t.name for t in spark.catalog.listTables()]


def test_table_names(spark, sales):
    for bad in ("1s", "a b", "x;y", "s\n"):
        with pytest.raises(InvalidRequest):
            run_select(spark, "SELECT 1", {bad: sales})
    with pytest.raises(InvalidRequest):
        run_select(spark, "SELECT 1", {})
