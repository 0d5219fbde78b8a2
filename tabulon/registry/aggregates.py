"""Aggregates, groupings, distinct values."""

from pyspark.sql import functions as F

from tabulon.functions.rounding import rounded
from tabulon.operators.explore import chart_series, grouped, query_counts, run_plan, run_query
from tabulon.operators.profile import distinct_values, modes, top_values
from tabulon.operators.stats import kpis
from tabulon.plans.specs import EXPLORE_LIMIT, QuerySpec
from tabulon.registry.base import query, table


def _nulled_values(spark, sf):
    return table(spark, sf, "events").select(
        "event_type", F.expr("nullif(event_type, 'error')").alias("kind"), "user_id",
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
    )


NULLED = """(SELECT event_type, nullif(event_type, 'error') AS kind, user_id,
    CASE WHEN event_type <> 'view' THEN value END AS value FROM events)"""


@query("agg_sum", f"SELECT event_type, round(coalesce(sum(value), 0), 4) AS value__sum FROM {NULLED} t GROUP BY 1")
def agg_sum(spark, sf):
    return rounded(grouped(_nulled_values(spark, sf), ["event_type"], [{"column": "value", "agg": "sum"}]))


@query("agg_mean", f"SELECT event_type, round(avg(value), 6) AS value__mean FROM {NULLED} t GROUP BY 1")
def agg_mean(spark, sf):
    return rounded(grouped(_nulled_values(spark, sf), ["event_type"], [{"column": "value", "agg": "mean"}]), 6)


@query(
    "agg_min_max",
    f"SELECT event_type, min(value) AS lowest, max(value) AS value__max FROM {NULLED} t GROUP BY 1",
)
def agg_min_max(spark, sf):
    specs = [{"column": "value", "agg": "min", "alias": "lowest"}, {"column": "value", "agg": "max"}]
    return grouped(_nulled_values(spark, sf), ["event_type"], specs)


@query(
    "agg_count",
    f"SELECT event_type, count(*) AS rows, count(value) AS value__count FROM {NULLED} t GROUP BY 1",
)
def agg_count(spark, sf):
    specs = [{"column": "*", "agg": "count", "alias": "rows"}, {"column": "value", "agg": "count"}]
    return grouped(_nulled_values(spark, sf), ["event_type"], specs)


@query(
    "agg_n_unique",
    f"""SELECT user_id, count(DISTINCT kind) + max(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) AS kind__n_unique
    FROM {NULLED} t GROUP BY 1""",
)
def agg_n_unique(spark, sf):
    return grouped(_nulled_values(spark, sf), ["user_id"], [{"column": "kind", "agg": "n_unique"}])


@query(
    "group_by_multi",
    """SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS rows, round(sum(l_quantity), 2) AS l_quantity__sum,
    round(avg(l_extendedprice), 4) AS price, max(l_tax) AS l_tax__max
    FROM lineitem GROUP BY 1, 2, 3""",
)
def group_by_multi(spark, sf):
    specs = [
        {"column": "_all_", "agg": "count", "alias": "rows"},
        {"column": "l_quantity"},
        {"column": "l_extendedprice", "agg": "mean", "alias": "price"},
        {"column": "l_tax", "agg": "max"},
    ]
    return rounded(grouped(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"], specs))


@query(
    "kpis",
    """SELECT * FROM (VALUES
    ('l_quantity', 'sum', (SELECT round(sum(l_quantity), 4) FROM lineitem), NULL),
    ('l_extendedprice', 'mean', (SELECT round(avg(l_extendedprice), 4) FROM lineitem), NULL),
    ('l_discount', 'max', (SELECT max(l_discount) FROM lineitem), NULL),
    ('l_tax', 'min', (SELECT min(l_tax) FROM lineitem), NULL),
    ('l_partkey', 'count', (SELECT CAST(count(*) AS DOUBLE) FROM lineitem), NULL),
    ('l_suppkey', 'typo', (SELECT CAST(sum(l_suppkey) AS DOUBLE) FROM lineitem), NULL),
    ('l_returnflag', NULL, NULL, 'column is not numeric'),
    ('missing', NULL, NULL, 'column not found')) t(kpi, agg, value, error)""",
)
def kpis_(spark, sf):
    wanted = {
        "l_quantity": "sum", "l_extendedprice": {"agg": "mean"}, "l_discount": "max", "l_tax": "min",
        "l_partkey": "count", "l_suppkey": {"agg": "typo"}, "l_returnflag": "sum", "missing": "sum",
    }
    return rounded(kpis(table(spark, sf, "lineitem"), wanted))


@query(
    "plan_group",
    """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue, count(l_orderkey) AS count_l_orderkey
    FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 ORDER BY revenue DESC LIMIT 50""",
)
def plan_group(spark, sf):
    plan = {
        "filters": [{"column": "l_quantity", "op": "gte", "value": 10}],
        "group_by": ["l_suppkey"],
        "aggregations": [
            {"column": "l_extendedprice", "agg": "sum", "alias": "revenue"},
            {"column": "l_orderkey", "agg": "count"},
        ],
        "sort_by": "revenue",
        "explanation": "revenue by supplier",
    }
    return rounded(run_plan(table(spark, sf, "lineitem"), plan), 2)


@query(
    "plan_total",
    """SELECT round(avg(o_totalprice), 4) AS mean_o_totalprice, max(o_totalprice) AS highest,
    count(DISTINCT o_custkey) AS n_unique_o_custkey FROM orders WHERE o_orderstatus = 'O'""",
)
def plan_total(spark, sf):
    plan = {
        "filters": [{"column": "o_orderstatus", "value": "O"}],
        "aggregations": [
            {"column": "o_totalprice", "agg": "mean"},
            {"column": "o_totalprice", "agg": "max", "alias": "highest"},
            {"column": "o_custkey", "agg": "n_unique"},
        ],
    }
    return rounded(run_plan(table(spark, sf, "orders"), plan))


EXPLORE = QuerySpec(
    mode="grouped",
    filters=[{"column": "l_shipdate", "op": "between", "value": ["1996-01-01", "1998-12-31"]}],
    group_by=["l_returnflag", "l_linestatus"],
    aggregations=[
        {"column": "l_quantity", "agg": "sum"},
        {"column": "l_extendedprice", "agg": "mean"},
        {"column": "*", "agg": "count", "alias": "rows"},
    ],
    sort_by="l_quantity__sum",
    sort_dir="desc",
    limit=200,
)


@query(
    "explore_grouped",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS l_quantity__sum,
    round(avg(l_extendedprice), 4) AS l_extendedprice__mean, count(*) AS rows
    FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'
    GROUP BY 1, 2 ORDER BY l_quantity__sum DESC LIMIT 200""",
)
def explore_grouped(spark, sf):
    return rounded(run_query(table(spark, sf, "lineitem"), EXPLORE, EXPLORE_LIMIT))


@query(
    "explore_counts",
    """SELECT count(*) AS source_rows,
    count(*) FILTER (l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31') AS filtered_rows,
    (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem
      WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31') g) AS total_rows FROM lineitem""",
)
def explore_counts(spark, sf):
    return query_counts(table(spark, sf, "lineitem"), EXPLORE)


@query(
    "explore_raw",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH'
    ORDER BY o_totalprice DESC, o_orderkey""",
)
def explore_raw(spark, sf):
    spec = QuerySpec(
        filters=[{"column": "o_orderpriority", "value": "2-HIGH"}],
        columns=["o_orderkey", "o_custkey", "o_totalprice"],
        sort_by="o_totalprice", sort_dir="desc",
    )
    return run_query(table(spark, sf, "orders"), spec)


@query(
    "saved_view",
    """SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS c_acctbal__sum
    FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2""",
)
def saved_view(spark, sf):
    spec = QuerySpec(
        mode="grouped",
        filters=[{"column": "c_acctbal", "op": "gt", "value": 0}],
        group_by=["c_mktsegment", "c_nationkey"],
        aggregations=[{"column": "c_acctbal", "agg": "sum"}],
    )
    return rounded(run_query(table(spark, sf, "customer"), QuerySpec.from_json(spec.to_json())), 2)


@query(
    "chart_series",
    """SELECT l_returnflag AS label, round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY 1""",
)
def chart_series_(spark, sf):
    result = grouped(table(spark, sf, "lineitem"), ["l_returnflag"], [{"column": "l_quantity"}])
    return rounded(chart_series(result, "l_returnflag", "l_quantity", [F.asc("l_returnflag")], 30))


@query(
    "top_values",
    """SELECT * FROM (
    SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM (
      SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL
      SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL
      SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2) c) r WHERE rank <= 5""",
)
def top_values_(spark, sf):
    return top_values(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query(
    "modes",
    """SELECT "column", value, n FROM (
    SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn,
      max(n) OVER (PARTITION BY "column") AS top FROM (
      SELECT 'c_name' AS "column", c_name AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL
      SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY 2) c) r
    WHERE n = top AND value IS NOT NULL""",
)
def modes_(spark, sf):
    return modes(table(spark, sf, "customer"), ["c_name", "c_mktsegment"])


@query(
    "column_values",
    """SELECT value, (SELECT count(DISTINCT p_name) FROM part WHERE regexp_matches(p_name, '(?i)RING|^b')) AS total_unique,
    (SELECT count(DISTINCT p_name) FROM part WHERE regexp_matches(p_name, '(?i)RING|^b')) > 50 AS truncated
    FROM (SELECT DISTINCT p_name AS value FROM part WHERE regexp_matches(p_name, '(?i)RING|^b') ORDER BY 1 LIMIT 50) v""",
)
def column_values(spark, sf):
    return distinct_values(table(spark, sf, "part"), "p_name", "RING|^b", 50)
