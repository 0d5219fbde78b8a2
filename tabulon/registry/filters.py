"""Selections, filters, sorting and paging."""

from datetime import date

from pyspark.sql import functions as F

from tabulon.functions.temporal import period_text
from tabulon.operators.explore import page, result_limits, result_rows, run_plan, run_query, sort_rows
from tabulon.operators.filters import apply_filters, drill_down, drill_down_groups, last_n_days
from tabulon.plans.specs import EXPLORE_LIMIT, QuerySpec
from tabulon.registry.base import query, table

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value"]
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]


def _events(spark, sf, *filters):
    return apply_filters(table(spark, sf, "events"), filters).select(*EVENT_COLUMNS)


def _with_nulls(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.expr("nullif(event_type, 'error')").alias("event_type"),
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
    )


NULLED = """(SELECT event_id, nullif(event_type, 'error') AS event_type,
    CASE WHEN value >= 5 THEN value END AS value FROM events)"""


@query("raw_select", "SELECT c_name, c_mktsegment, c_acctbal FROM customer")
def raw_select(spark, sf):
    return run_query(table(spark, sf, "customer"), QuerySpec(columns=["c_name", "c_mktsegment", "c_acctbal"]))


@query("filter_eq", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase'")
def filter_eq(spark, sf):
    return _events(spark, sf, {"column": "event_type", "op": "eq", "value": "purchase"})


@query(
    "filter_ne",
    f"SELECT event_id, event_type, value FROM {NULLED} t WHERE event_type <> 'click'",
)
def filter_ne(spark, sf):
    return apply_filters(_with_nulls(spark, sf), [{"column": "event_type", "op": "ne", "value": "click"}])


@query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def filter_contains(spark, sf):
    return apply_filters(
        table(spark, sf, "part"), [{"column": "p_name", "op": "contains", "value": "ring"}]
    ).select("p_partkey", "p_name")


@query(
    "filter_not_contains",
    f"SELECT event_id, event_type, value FROM {NULLED} t WHERE NOT contains(event_type, 'c')",
)
def filter_not_contains(spark, sf):
    return apply_filters(_with_nulls(spark, sf), [{"column": "event_type", "op": "not_contains", "value": "c"}])


@query(
    "filter_range",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem
    WHERE l_quantity > 10 AND l_quantity <= 40 AND l_extendedprice >= 20000
      AND l_shipdate < TIMESTAMP '1999-01-01'""",
)
def filter_range(spark, sf):
    return apply_filters(
        table(spark, sf, "lineitem"),
        [
            {"column": "l_quantity", "op": "gt", "value": "10"},
            {"column": "l_quantity", "op": "lte", "value": 40},
            {"column": "l_extendedprice", "op": "gte", "value": 20000},
            {"column": "l_shipdate", "op": "lt", "value": "1999-01-01"},
        ],
    ).select(*LINE_COLUMNS)


@query(
    "filter_between",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem
    WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'
      AND l_quantity BETWEEN 5 AND 20""",
)
def filter_between(spark, sf):
    return apply_filters(
        table(spark, sf, "lineitem"),
        [
            {"column": "l_shipdate", "op": "between", "value": "1996-01-01..1997-06-30"},
            {"column": "l_quantity", "op": "between", "value": {"from": 20, "to": 5}},
        ],
    ).select(*LINE_COLUMNS)


@query("filter_null", f"SELECT event_id, event_type, value FROM {NULLED} t WHERE event_type IS NULL")
def filter_null(spark, sf):
    return apply_filters(_with_nulls(spark, sf), [{"column": "event_type", "op": "is_null"}])


@query("filter_not_null", f"SELECT event_id, event_type, value FROM {NULLED} t WHERE value IS NOT NULL")
def filter_not_null(spark, sf):
    return apply_filters(_with_nulls(spark, sf), [{"column": "value", "op": "not_null"}])


@query(
    "filter_in_list",
    "SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('view', 'signup')",
)
def filter_in_list(spark, sf):
    return _events(spark, sf, {"column": "event_type", "op": "in_list", "value": "view, signup"})


@query(
    "filter_all",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority <> '1-URGENT'
      AND o_orderdate >= TIMESTAMP '1996-01-01'""",
)
def filter_all(spark, sf):
    return apply_filters(
        table(spark, sf, "orders"),
        [
            {"column": "o_orderstatus", "value": "F"},
            {"column": "", "op": "eq", "value": "skipped"},
            {"column": "o_totalprice", "op": "gt", "value": "100000"},
            {"column": "o_orderpriority", "op": "ne", "value": "1-URGENT"},
            {"column": "o_orderdate", "op": "gte", "value": "1996-01-01"},
        ],
    ).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "plan_filter",
    """SELECT c_custkey, c_name, c_acctbal FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0
    ORDER BY c_acctbal DESC NULLS FIRST, c_custkey, c_name LIMIT 200""",
)
def plan_filter(spark, sf):
    return run_plan(
        table(spark, sf, "customer"),
        {
            "filters": [
                {"column": "c_mktsegment", "op": "in", "value": ["BUILDING", "MACHINERY"]},
                {"column": "c_acctbal", "op": "gt", "value": 0},
            ],
            "columns": ["c_custkey", "c_name", "c_acctbal"],
            "sort_by": "c_acctbal",
            "limit": 200,
        },
    )


@query(
    "last_n_days",
    """SELECT event_id, user_id, event_type, value FROM events
    WHERE ts >= TIMESTAMP '2024-01-14' AND ts <= TIMESTAMP '2024-01-21 23:59:59.999999'""",
)
def last_n_days_(spark, sf):
    return last_n_days(table(spark, sf, "events"), 7, date(2024, 1, 21)).select(*EVENT_COLUMNS)


@query(
    "drill_down",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus = 'O'""",
)
def drill_down_(spark, sf):
    return drill_down(table(spark, sf, "lineitem"), {"l_returnflag": "R", "l_linestatus": "O"}).select(*LINE_COLUMNS)


@query(
    "drill_down_groups",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (
    SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 10)""",
)
def drill_down_groups_(spark, sf):
    orders = table(spark, sf, "orders")
    busy = orders.groupBy("o_custkey").count().filter("count >= 10")
    return drill_down_groups(orders, busy, ["o_custkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "sort_nulls_last",
    f"""SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS place, event_id, value
    FROM (SELECT * FROM {NULLED} t ORDER BY value DESC NULLS LAST, event_id LIMIT 500) s""",
)
def sort_nulls_last(spark, sf):
    from pyspark.sql import Window

    top = sort_rows(_with_nulls(spark, sf), "value", "desc", ties=["event_id"]).limit(500)
    order = Window.orderBy(F.col("value").desc_nulls_last(), "event_id")
    return top.select(F.row_number().over(order).alias("place"), "event_id", "value")


@query(
    "page",
    "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 100",
)
def page_(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return page(parts, 100, 50, [F.desc("p_retailprice"), F.asc("p_partkey")])


@query(
    "result_limits",
    """SELECT count(*) AS total_rows, least(count(*), 2000) AS returned_rows, count(*) > 2000 AS truncated,
    count(*) >= 10000 AS large_grouping
    FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey) g""",
)
def result_limits_(spark, sf):
    spec = QuerySpec(mode="grouped", group_by=["l_partkey", "l_suppkey"])
    return result_limits(result_rows(table(spark, sf, "lineitem"), spec), "grouped", EXPLORE_LIMIT)


@query(
    "period_text",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week,
    strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS orders
    FROM orders GROUP BY ALL""",
)
def period_text_(spark, sf):
    when = F.col("o_orderdate")
    return table(spark, sf, "orders").groupBy(
        period_text(when, "day").alias("day"), period_text(when, "week").alias("week"),
        period_text(when, "month").alias("month"),
    ).agg(F.count(F.lit(1)).alias("orders"))
