"""Report tables, guarded SQL, summaries."""

from functools import reduce

from pyspark.sql import DataFrame

from tabulon.functions.rounding import rounded
from tabulon.operators.report import (
    build_report, context_summary, grouped_table, leaders, long_form, top_tables,
)
from tabulon.plans.sqlguard import run_select
from tabulon.registry.base import query, table


@query(
    "report_grouped",
    """SELECT l_suppkey, count(*) AS count, round(sum(l_quantity), 2) AS l_quantity__sum, round(avg(l_quantity), 2) AS l_quantity__mean,
    min(l_quantity) AS l_quantity__min, max(l_quantity) AS l_quantity__max,
    round(100 * count(*) / (SELECT count(*) FROM lineitem), 2) AS share_pct
    FROM lineitem GROUP BY 1 ORDER BY count DESC, l_suppkey LIMIT 20""",
)
def report_grouped(spark, sf):
    return rounded(grouped_table(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_quantity"], 10), 2)


@query(
    "report_top_n",
    """WITH g AS (SELECT l_returnflag, l_suppkey, count(*) AS count, sum(l_quantity) AS q, avg(l_quantity) AS qm,
      sum(l_extendedprice) AS p, avg(l_extendedprice) AS pm FROM lineitem GROUP BY 1, 2),
    l AS (SELECT 'l_quantity' AS metric, l_returnflag, l_suppkey, count, q AS sum, qm AS mean FROM g UNION ALL
      SELECT 'l_extendedprice', l_returnflag, l_suppkey, count, p, pm FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY sum DESC, l_returnflag, l_suppkey) AS rank FROM l)
    SELECT metric, CAST(rank AS INT) AS rank, l_returnflag, l_suppkey, count, round(sum, 2) AS sum, round(mean, 2) AS mean
    FROM r WHERE rank <= 10""",
)
def report_top_n(spark, sf):
    keys, metrics = ["l_returnflag", "l_suppkey"], ["l_quantity", "l_extendedprice"]
    return rounded(top_tables(table(spark, sf, "lineitem"), keys, metrics, 10), 2)


@query(
    "report_leaders",
    """WITH g AS (SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1),
    r AS (SELECT *, round(100 * n / (SELECT sum(n) FROM g), 2) AS share,
      row_number() OVER (ORDER BY n DESC, o_orderpriority) AS rn FROM g)
    SELECT 'largest_group' AS fact, o_orderpriority AS label, CAST(n AS DOUBLE) AS value, share FROM r WHERE rn = 1
    UNION ALL SELECT 'top_three_share', '', sum(n), round(sum(share), 1) FROM r WHERE rn <= 3 HAVING round(sum(share), 1) >= 50
    UNION ALL SELECT 'top_o_totalprice', o_orderpriority, round(s, 2), NULL FROM (
      SELECT * FROM g ORDER BY s DESC, o_orderpriority LIMIT 1) t""",
)
def report_leaders(spark, sf):
    return rounded(leaders(table(spark, sf, "orders"), ["o_orderpriority"], ["o_totalprice"]), 2)


@query("report")
def report(spark, sf):
    tables = build_report(
        table(spark, sf, "orders"), "full", ["o_orderpriority"], ["o_totalprice", "o_custkey"],
        filters=[{"column": "o_orderstatus", "op": "ne", "value": "P"}], order_by=["o_orderkey"],
    )
    return reduce(DataFrame.unionByName, [long_form(name, t) for name, t in tables.items()])


@query("context_summary")
def context_summary_(spark, sf):
    return context_summary(
        table(spark, sf, "part"), ["p_brand"], [{"column": "p_retailprice", "agg": "mean"}], ["p_partkey"]
    )


SQL_TEXT = """WITH spend AS (
  SELECT o.o_custkey AS custkey, sum(o.o_totalprice) AS total, count(*) AS n FROM o GROUP BY o.o_custkey)
SELECT c.c_mktsegment, c.c_nationkey, round(sum(spend.total), 2) AS total, sum(spend.n) AS orders
FROM c JOIN spend ON c.c_custkey = spend.custkey GROUP BY c.c_mktsegment, c.c_nationkey
ORDER BY total DESC"""


@query(
    "sql_select",
    """SELECT c_mktsegment, c_nationkey, round(sum(o_totalprice), 2) AS total, count(*) AS orders
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY total DESC LIMIT 100""",
)
def sql_select(spark, sf):
    return run_select(spark, SQL_TEXT, {"c": table(spark, sf, "customer"), "o": table(spark, sf, "orders")}, 100)
