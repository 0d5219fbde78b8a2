"""Quality, profile, cleaning."""

from datetime import datetime

from pyspark.sql import functions as F

from tabulon.functions.rounding import rounded
from tabulon.operators.cleaning import (
    CleaningPlan, cell_diff, clean_missing, clean_table, normalize_strings, remove_duplicates,
    remove_outliers, row_changes,
)
from tabulon.operators.ordering import forward_fill, row_numbers
from tabulon.operators.profile import duplicate_rows, profile, profile_insights, quality, quality_issues
from tabulon.registry.base import query, table, texts

HOLED = """(SELECT event_id, user_id, nullif(event_type, 'error') AS event_type,
    CASE WHEN value >= 5 THEN value END AS value,
    CASE WHEN event_type <> 'view' THEN user_id * 3 END AS points FROM events)"""


def _holed(spark, sf):
    """Events with empty cells in text, fractions and whole numbers."""
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.expr("nullif(event_type, 'error')").alias("event_type"),
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
        F.when(F.col("event_type") != "view", F.col("user_id") * 3).alias("points"),
    )


@query("clean_drop", f"SELECT * FROM {HOLED} t WHERE event_type IS NOT NULL AND value IS NOT NULL AND points IS NOT NULL")
def clean_drop(spark, sf):
    return clean_missing(_holed(spark, sf), "drop")


@query(
    "clean_fill_zero",
    f"""SELECT event_id, user_id, event_type, coalesce(value, 0) AS value, coalesce(points, 0) AS points
    FROM {HOLED} t""",
)
def clean_fill_zero(spark, sf):
    return clean_missing(_holed(spark, sf), "fill_zero")


@query(
    "clean_fill_mean",
    f"""SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, event_type,
    round(coalesce(value, (SELECT avg(value) FROM {HOLED} t)), 4) AS value,
    round(coalesce(points, (SELECT avg(points) FROM {HOLED} t)), 4) AS points FROM {HOLED} t""",
)
def clean_fill_mean(spark, sf):
    return rounded(clean_missing(_holed(spark, sf), "mean"))


@query(
    "clean_fill_median",
    f"""SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, event_type,
    round(coalesce(value, (SELECT median(value) FROM {HOLED} t)), 4) AS value,
    round(coalesce(points, (SELECT median(points) FROM {HOLED} t)), 4) AS points FROM {HOLED} t""",
)
def clean_fill_median(spark, sf):
    return rounded(clean_missing(_holed(spark, sf), "fill_median"))


@query(
    "clean_fill_unknown",
    f"""SELECT event_id, user_id, coalesce(event_type, 'Unknown') AS event_type, coalesce(value, 0) AS value,
    coalesce(points, 0) AS points FROM {HOLED} t""",
)
def clean_fill_unknown(spark, sf):
    return clean_missing(_holed(spark, sf), "unknown")


@query(
    "clean_fill_value",
    f"""SELECT event_id, user_id, coalesce(event_type, 'none') AS event_type, value, points FROM {HOLED} t""",
)
def clean_fill_value(spark, sf):
    return clean_missing(_holed(spark, sf), "fill", "none")


@query(
    "clean_fill_default",
    f"""SELECT event_id, user_id, coalesce(event_type, '') AS event_type, coalesce(value, 0) AS value,
    coalesce(points, 0) AS points FROM {HOLED} t""",
)
def clean_fill_default(spark, sf):
    return clean_missing(_holed(spark, sf), "fill", as_of=datetime(2024, 2, 1))


@query(
    "forward_fill",
    f"""SELECT event_id, last_value(user_id IGNORE NULLS) OVER w AS user_id,
    last_value(event_type IGNORE NULLS) OVER w AS event_type, last_value(value IGNORE NULLS) OVER w AS value,
    last_value(points IGNORE NULLS) OVER w AS points FROM {HOLED} t
    WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def forward_fill_(spark, sf):
    return clean_missing(_holed(spark, sf), "ffill", order_by=["event_id"])


@query(
    "forward_fill_by_key",
    f"""SELECT event_id, user_id, last_value(event_type IGNORE NULLS) OVER w AS event_type,
    last_value(value IGNORE NULLS) OVER w AS value, last_value(points IGNORE NULLS) OVER w AS points FROM {HOLED} t
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def forward_fill_by_key(spark, sf):
    return forward_fill(_holed(spark, sf), ["event_id"], ["user_id"])


@query(
    "row_numbers",
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number FROM orders""",
)
def row_numbers_(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return row_numbers(orders, ["o_totalprice", "o_orderkey"])


@query("dedupe_rows", "SELECT DISTINCT lang, source, text FROM documents")
def dedupe_rows(spark, sf):
    return remove_duplicates(table(spark, sf, "documents").select("lang", "source", "text"))


@query(
    "dedupe_subset",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (
    SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey
        ORDER BY l_orderkey, l_linenumber, l_quantity) AS rn FROM lineitem) t WHERE rn = 1""",
)
def dedupe_subset(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return remove_duplicates(lines, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_rows",
    """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents) d)
    AS duplicate_rows FROM documents""",
)
def duplicate_rows_(spark, sf):
    return duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


@query(
    "quality",
    f"""WITH t AS (SELECT user_id, event_type, points FROM {HOLED} h),
    s AS (SELECT count(*) AS rows, sum((event_type IS NULL)::INT + (points IS NULL)::INT) AS missing FROM t),
    d AS (SELECT count(*) AS kept FROM (SELECT DISTINCT * FROM t))
    SELECT rows, 3 AS columns, CAST(missing AS BIGINT) AS missing, rows - kept AS duplicate_rows,
    round(1 - missing / (rows * 3), 4) AS completeness, round(1 - (rows - kept) / rows, 4) AS uniqueness
    FROM s, d""",
)
def quality_(spark, sf):
    return quality(_holed(spark, sf).select("user_id", "event_type", "points"))


@query(
    "quality_issues",
    f"""SELECT * FROM (
    SELECT 'event_type' AS "column", count(*) - count(event_type) AS missing,
      round((count(*) - count(event_type)) / count(*), 4) AS ratio FROM {HOLED} t UNION ALL
    SELECT 'value', count(*) - count(value), round((count(*) - count(value)) / count(*), 4) FROM {HOLED} t UNION ALL
    SELECT 'points', count(*) - count(points), round((count(*) - count(points)) / count(*), 4) FROM {HOLED} t) q
    WHERE ratio >= 0.05""",
)
def quality_issues_(spark, sf):
    return quality_issues(_holed(spark, sf))


@query(
    "profile",
    f"""SELECT "column", kind, missing, missing_pct, "unique", mean FROM (
    SELECT 'event_type' AS "column", 'string' AS kind, count(*) - count(event_type) AS missing,
      round(100 * (count(*) - count(event_type)) / count(*), 2) AS missing_pct,
      count(DISTINCT event_type) + 1 AS "unique", NULL AS mean FROM {HOLED} t UNION ALL
    SELECT 'value', 'number', count(*) - count(value), round(100 * (count(*) - count(value)) / count(*), 2),
      count(DISTINCT value) + 1, round(avg(value), 4) FROM {HOLED} t UNION ALL
    SELECT 'user_id', 'number', 0, 0.0, count(DISTINCT user_id), round(avg(user_id), 4) FROM {HOLED} t UNION ALL
    SELECT 'points', 'number', count(*) - count(points), round(100 * (count(*) - count(points)) / count(*), 2),
      count(DISTINCT points) + 1, round(avg(points), 4) FROM {HOLED} t) p""",
)
def profile_(spark, sf):
    holed = _holed(spark, sf).drop("event_id")
    return rounded(profile(holed).select("column", "kind", "missing", "missing_pct", "unique", "mean"))


@query(
    "profile_ranges",
    """SELECT 'o_orderdate' AS "column", 'datetime' AS kind, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min,
    strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max, count(DISTINCT o_orderdate) AS "unique" FROM orders
    UNION ALL SELECT 'o_orderkey', 'number', CAST(min(o_orderkey) AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR),
    count(DISTINCT o_orderkey) FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', NULL, NULL, count(DISTINCT o_orderstatus) FROM orders""",
)
def profile_ranges(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return profile(orders).select("column", "kind", "min", "max", "unique")


@query(
    "profile_insights",
    f"""WITH t AS (SELECT user_id, event_type, value, points FROM {HOLED} h),
    s AS (SELECT count(*) AS rows, count(*) - count(event_type) AS m1, count(*) - count(value) AS m2,
      count(*) - count(points) AS m3 FROM t),
    d AS (SELECT count(*) AS kept FROM (SELECT DISTINCT * FROM t))
    SELECT 'rows' AS rule, NULL AS "column", CAST(rows AS DOUBLE) AS value FROM s
    UNION ALL SELECT 'completeness', NULL, round(1 - (m1 + m2 + m3) / (rows * 4), 4) FROM s
      WHERE round(1 - (m1 + m2 + m3) / (rows * 4), 4) < 0.95
    UNION ALL SELECT 'duplicate_rows', NULL, rows - kept FROM s, d WHERE rows > kept
    UNION ALL SELECT 'category', 'event_type', count(DISTINCT event_type) + 1 FROM t
    UNION ALL SELECT 'numeric_columns', NULL, 3
    UNION ALL SELECT 'missing_pct', c, p FROM (SELECT * FROM (
      SELECT 1 AS i, 'event_type' AS c, round(100 * m1 / rows, 2) AS p FROM s UNION ALL
      SELECT 2, 'value', round(100 * m2 / rows, 2) FROM s UNION ALL
      SELECT 3, 'points', round(100 * m3 / rows, 2) FROM s) x WHERE p >= 10) y""",
)
def profile_insights_(spark, sf):
    return profile_insights(_holed(spark, sf).drop("event_id"))


@query(
    "normalize_strings",
    r"""SELECT doc_id, lower(trim(regexp_replace(text, '[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]+', ' ', 'g'))) AS text,
    lower(lang) AS lang FROM documents""",
)
def normalize_strings_(spark, sf):
    return normalize_strings(texts(spark, sf, "documents").select("doc_id", "text", "lang"))


def _fence(column: str, source: str) -> str:
    return f"""SELECT max(CASE WHEN rn = floor((n - 1) * 0.25 + 0.5) + 1 THEN x END) AS q1,
    max(CASE WHEN rn = floor((n - 1) * 0.75 + 0.5) + 1 THEN x END) AS q3 FROM (
    SELECT {column} AS x, row_number() OVER (ORDER BY {column}) AS rn, count(*) OVER () AS n FROM {source}) o"""


@query(
    "iqr_outliers",
    f"""WITH f1 AS ({_fence("l_extendedprice", "lineitem")}),
    s1 AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem, f1
      WHERE l_extendedprice BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)),
    f2 AS ({_fence("l_quantity", "s1")})
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM s1, f2
    WHERE l_quantity BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""",
)
def iqr_outliers(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"
    )
    return remove_outliers(lines, ["l_extendedprice", "l_quantity"], factor=0.5)


@query(
    "iqr_outliers_joint",
    f"""WITH f1 AS ({_fence("value", "events")}), f2 AS ({_fence("user_id", "events")})
    SELECT event_id, user_id, value FROM events, f1, f2
    WHERE value BETWEEN f1.q1 - 1.5 * (f1.q3 - f1.q1) AND f1.q3 + 1.5 * (f1.q3 - f1.q1)
    AND user_id BETWEEN f2.q1 - 1.5 * (f2.q3 - f2.q1) AND f2.q3 + 1.5 * (f2.q3 - f2.q1)""",
)
def iqr_outliers_joint(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    return remove_outliers(events, ["value", "user_id"], joint=True)


CLEANED = f"""(WITH d AS (SELECT DISTINCT user_id, lower(event_type) AS event_type, value FROM {HOLED} t
      WHERE event_type IS NOT NULL AND value IS NOT NULL),
    f1 AS ({_fence("user_id", "d")}),
    s1 AS (SELECT d.* FROM d, f1 WHERE user_id BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
    f2 AS ({_fence("value", "s1")})
    SELECT s1.* FROM s1, f2 WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


@query("clean_table", f"SELECT * FROM {CLEANED} c")
def clean_table_(spark, sf):
    holed = _holed(spark, sf).select("user_id", "event_type", "value")
    return clean_table(holed, CleaningPlan(outliers=True))[0]


@query(
    "cell_diff",
    f"""SELECT event_id, 'event_type' AS "column", event_type AS before, 'Unknown' AS after
    FROM {HOLED} t WHERE event_type IS NULL""",
)
def cell_diff_(spark, sf):
    before = _holed(spark, sf).select("event_id", "event_type", "user_id")
    return cell_diff(before, clean_missing(before, "unknown"), ["event_id"])


@query(
    "row_changes",
    f"""SELECT count(*) AS rows_before, count(event_type) AS rows_after, count(*) - count(event_type) AS rows_removed
    FROM {HOLED} t""",
)
def row_changes_(spark, sf):
    before = _holed(spark, sf).select("event_id", "event_type")
    return row_changes(before, clean_missing(before, "drop"))
