"""Statistics, correlation, anomalies, time series, rankings, charts."""

from pyspark.sql import functions as F

from tabulon.functions.rounding import rounded
from tabulon.operators.charts import histogram, scatter_points
from tabulon.operators.patterns import (
    concentrated, missing_pattern, patterns, rare_groups, skew, strong_pairs,
)
from tabulon.operators.series import (
    compare_periods, forecast, forecast_by_key, pareto, pareto_summary, timeseries,
)
from tabulon.operators.stats import correlation_matrix, statistics, top_anomalies, top_correlations
from tabulon.registry.base import query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _nearest(column: str, source: str, q: float) -> str:
    return f"""(SELECT CAST(x AS DOUBLE) FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) AS rn,
    count(*) OVER () AS n FROM {source} WHERE {column} IS NOT NULL) o WHERE rn = floor((n - 1) * {q} + 0.5) + 1)"""


def _number_statistics(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS count, count(*) - count({column}) AS missing,
    round(avg({column}), 4) AS mean, round(median({column}), 4) AS median,
    round(stddev_samp({column}), 4) AS std, CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max,
    {_nearest(column, source, 0.25)} AS q25, {_nearest(column, source, 0.75)} AS q75,
    CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS most_common FROM {source}"""


def _text_statistics(column: str, source: str) -> str:
    return f"""SELECT '{column}', count(*), count(*) - count({column}), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    count(DISTINCT {column}) + max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END),
    (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT v, n, max(n) OVER () AS top, row_number() OVER (ORDER BY n DESC, v) AS rn
      FROM (SELECT {column} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1) c) m WHERE n = top AND rn <= 5)
    FROM {source}"""


PART_HOLED = "(SELECT p_name, p_brand, nullif(p_type, 'SMALL') AS p_type, p_size, CASE WHEN p_retailprice < 2000 THEN p_retailprice END AS p_retailprice FROM part)"


@query(
    "statistics",
    " UNION ALL ".join(
        [_number_statistics(c, f"{PART_HOLED} t") for c in ("p_size", "p_retailprice")]
        + [_text_statistics(c, f"{PART_HOLED} t") for c in ("p_name", "p_brand", "p_type")]
    ),
)
def statistics_(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_name", "p_brand", F.expr("nullif(p_type, 'SMALL')").alias("p_type"), "p_size",
        F.when(F.col("p_retailprice") < 2000, F.col("p_retailprice")).alias("p_retailprice"),
    )
    out = statistics(parts).drop("position", "dtype")
    return rounded(out.withColumn("most_common", F.array_join("most_common", ",")))


@query(
    "statistics_lineitem",
    " UNION ALL ".join(_number_statistics(c, "lineitem") for c in NUMBERS),
)
def statistics_lineitem(spark, sf):
    out = statistics(table(spark, sf, "lineitem"), NUMBERS).drop("position", "dtype")
    return rounded(out.withColumn("most_common", F.array_join("most_common", ",")))


def _all_pairs(columns, source: str, digits: int = 6) -> str:
    cells = ", ".join(
        f"('{a}', '{b}', (SELECT round(corr({a}, {b}), {digits}) FROM {source}))" for a in columns for b in columns
    )
    return f"SELECT * FROM (VALUES {cells}) t(a, b, corr)"


@query("corr_pearson", _all_pairs(NUMBERS, "lineitem"))
def corr_pearson(spark, sf):
    return correlation_matrix(table(spark, sf, "lineitem").select(*NUMBERS))


RANKS = """(SELECT ra.event_id, (rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0)::DOUBLE AS user_id,
    (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0)::DOUBLE AS value,
    (rank() OVER (ORDER BY hour) + (count(*) OVER (PARTITION BY hour) - 1) / 2.0)::DOUBLE AS hour
    FROM (SELECT event_id, user_id, value, hour(ts) AS hour FROM events) ra)"""


@query("corr_spearman", _all_pairs(["user_id", "value", "hour"], f"{RANKS} r"))
def corr_spearman(spark, sf):
    events = table(spark, sf, "events").select("user_id", "value", F.hour("ts").alias("hour"))
    return correlation_matrix(events, "spearman")


@query(
    "top_correlations",
    """SELECT a, b, round(corr, 4) AS corr FROM (VALUES
    ('l_orderkey', 'l_quantity', (SELECT corr(l_orderkey, l_quantity) FROM lineitem)),
    ('l_orderkey', 'l_extendedprice', (SELECT corr(l_orderkey, l_extendedprice) FROM lineitem)),
    ('l_orderkey', 'revenue', (SELECT corr(l_orderkey, l_extendedprice * (1 - l_discount)) FROM lineitem)),
    ('l_quantity', 'l_extendedprice', (SELECT corr(l_quantity, l_extendedprice) FROM lineitem)),
    ('l_quantity', 'revenue', (SELECT corr(l_quantity, l_extendedprice * (1 - l_discount)) FROM lineitem)),
    ('l_extendedprice', 'revenue', (SELECT corr(l_extendedprice, l_extendedprice * (1 - l_discount)) FROM lineitem))
    ) t(a, b, corr) WHERE abs(corr) >= 0.3 ORDER BY abs(corr) DESC, a, b LIMIT 10""",
)
def top_correlations_(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )
    return top_correlations(lines)


@query(
    "anomalies",
    """WITH m AS (SELECT avg(o_totalprice) AS mp, stddev_samp(o_totalprice) AS sp, avg(o_custkey) AS mc,
      stddev_samp(o_custkey) AS sc FROM orders),
    z AS (SELECT o_totalprice, o_custkey, abs(o_totalprice - mp) / sp AS zp, abs(o_custkey - mc) / sc AS zc FROM orders, m),
    s AS (SELECT *, greatest(zp, zc) AS score FROM z),
    r AS (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM s),
    t AS (SELECT score AS threshold FROM r WHERE rn = floor((n - 1) * (1.0::DOUBLE - 0.05) + 0.5) + 1),
    k AS (SELECT s.* FROM s, t WHERE score >= threshold)
    SELECT o_totalprice, o_custkey, round(zp, 6) AS z_o_totalprice, round(zc, 6) AS z_o_custkey,
    round(score, 6) AS score, (SELECT count(*) FROM k) AS anomaly_count
    FROM k ORDER BY k.score DESC, o_totalprice, o_custkey LIMIT 100""",
)
def anomalies_(spark, sf):
    return rounded(top_anomalies(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], 0.05), 6)


@query(
    "forecast",
    """WITH r AS (SELECT o_orderdate, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_totalprice) AS rn,
      row_number() OVER (ORDER BY o_orderdate DESC, o_totalprice DESC) AS back, count(*) OVER () AS n FROM orders),
    f AS (SELECT max(n) AS n, avg(o_totalprice) AS mean, avg(CASE WHEN back <= 7 THEN o_totalprice END) AS recent,
      max(CASE WHEN rn = 1 THEN o_totalprice END) AS first, max(CASE WHEN back = 1 THEN o_totalprice END) AS last,
      max(o_orderdate) AS last_date FROM r)
    SELECT strftime(last_date, '%Y-%m-%d') AS last_date, CAST(step AS INT) AS step,
    round(recent + (last - first) / (n - 1) * step, 4) AS yhat, round(mean, 4) AS baseline_mean
    FROM f, generate_series(1, 14) g(step)""",
)
def forecast_(spark, sf):
    out = forecast(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 14)
    return out.withColumn("last_date", F.date_format("last_date", "yyyy-MM-dd"))


@query(
    "forecast_by_key",
    """WITH r AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS rn,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS back,
      count(*) OVER (PARTITION BY user_id) AS n FROM events),
    f AS (SELECT user_id, max(n) AS n, avg(value) AS mean, avg(CASE WHEN back <= 7 THEN value END) AS recent,
      max(CASE WHEN rn = 1 THEN value END) AS first, max(CASE WHEN back = 1 THEN value END) AS last
      FROM r GROUP BY user_id HAVING max(n) > 1)
    SELECT user_id, CAST(step AS INT) AS step, round(recent + (last - first) / (n - 1) * step, 4) AS yhat,
    round(mean, 4) AS baseline_mean FROM f, generate_series(1, 5) g(step)""",
)
def forecast_by_key_(spark, sf):
    return forecast_by_key(table(spark, sf, "events"), ["user_id"], "ts", "value", 5).drop("last_date")


def _series_sql(unit: str, agg: str) -> str:
    return f"""WITH g AS (SELECT strftime(date_trunc('{unit}', o_orderdate), '%Y-%m-%d') AS period,
      {agg}(o_totalprice) AS o_totalprice FROM orders GROUP BY 1)
    SELECT period, round(o_totalprice, 2) AS o_totalprice,
    round(100 * (o_totalprice - lag(o_totalprice) OVER (ORDER BY period)) / nullif(lag(o_totalprice) OVER (ORDER BY period), 0), 2)
    AS o_totalprice__delta_pct FROM g"""


@query("timeseries_day", _series_sql("day", "sum"))
def timeseries_day(spark, sf):
    return rounded(timeseries(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"], "day", "sum"), 2)


@query("timeseries_week", _series_sql("week", "avg"))
def timeseries_week(spark, sf):
    return rounded(timeseries(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"], "week", "mean"), 2)


@query("timeseries_month", _series_sql("month", "max"))
def timeseries_month(spark, sf):
    return rounded(timeseries(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"], "month", "max"), 2)


@query(
    "pareto",
    """WITH g AS (SELECT p_name, sum(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    r AS (SELECT *, 100 * value / (SELECT sum(value) FROM g) AS share, row_number() OVER (ORDER BY value DESC, p_name) AS rank FROM g)
    SELECT p_name, round(value, 2) AS value, CAST(rank AS INT) AS rank, round(share, 2) AS share_pct,
    round(sum(share) OVER (ORDER BY rank), 2) AS cum_share_pct FROM r WHERE rank <= 20""",
)
def pareto_(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    lines = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(pareto(lines, ["p_name"], "l_extendedprice"), 2)


@query(
    "hhi",
    """WITH g AS (SELECT p_brand, count(*)::DOUBLE AS value FROM part GROUP BY 1), s AS (SELECT sum(value) AS t FROM g),
    r AS (SELECT row_number() OVER (ORDER BY value DESC, p_brand) AS rank,
      round(sum(100 * value / t) OVER (ORDER BY value DESC, p_brand), 2) AS c FROM g, s)
    SELECT count(*) AS groups, round(max(t), 2) AS total, round(sum(value * value) / max(t * t), 4) AS hhi,
    (SELECT min(rank) FROM r WHERE c >= 80 AND rank <= 30) AS groups_to_80 FROM g, s""",
)
def hhi(spark, sf):
    return rounded(pareto_summary(table(spark, sf, "part"), ["p_brand"], "p_size", "count"))


@query(
    "compare_periods",
    """WITH s AS (SELECT round(sum(CASE WHEN a THEN o_totalprice END), 4) AS sa, round(sum(CASE WHEN b THEN o_totalprice END), 4) AS sb,
      round(avg(CASE WHEN a THEN o_totalprice END), 4) AS ma, round(avg(CASE WHEN b THEN o_totalprice END), 4) AS mb,
      count(*) FILTER (a) AS ca, count(*) FILTER (b) AS cb FROM (SELECT o_totalprice,
        o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59.999999' AS a,
        o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31 23:59:59.999999' AS b FROM orders) o)
    SELECT 'o_totalprice' AS "column", 'sum' AS stat, round(sa, 2) AS period_a, round(sb, 2) AS period_b, round(sb - sa, 2) AS delta,
      round(100 * (sb - sa) / sa, 2) AS delta_pct FROM s
    UNION ALL SELECT 'o_totalprice', 'mean', round(ma, 2), round(mb, 2), round(mb - ma, 2), round(100 * (mb - ma) / ma, 2) FROM s
    UNION ALL SELECT 'o_totalprice', 'count', ca, cb, cb - ca, NULL FROM s""",
)
def compare_periods_(spark, sf):
    return rounded(
        compare_periods(
            table(spark, sf, "orders"), "o_orderdate", ("1996-01-01", "1996-12-31"), ("1997-01-01", "1997-12-31"),
            ["o_totalprice"],
        ),
        2,
    )


@query(
    "histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS low, (max(l_extendedprice) - min(l_extendedprice)) / 12 AS w FROM lineitem),
    c AS (SELECT least(CAST(floor((l_extendedprice - low) / w) AS INT), 11) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT CAST(i AS INT) AS bin, round(low + i * w, 2) AS bin_low, round(low + (i + 1) * w, 2) AS bin_high, coalesce(n, 0) AS n
    FROM e, generate_series(0, 11) g(i) LEFT JOIN c ON c.bin = i""",
)
def histogram_(spark, sf):
    return histogram(table(spark, sf, "lineitem"), "l_extendedprice")


@query(
    "scatter",
    "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem",
)
def scatter(spark, sf):
    return scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


def _skewed(column: str, source: str) -> str:
    return f"""SELECT 'skew' AS kind, '{column}' AS subject, (avg({column}) - median({column})) / stddev_samp({column}) AS s
    FROM {source} HAVING count({column}) >= 10"""


RETURNS = "(SELECT l_quantity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem)"


@query(
    "pattern_skew",
    f"""SELECT kind, subject, round(s, 3) AS strength FROM (
    {" UNION ALL ".join(_skewed(c, f"{RETURNS} t") for c in ("l_quantity", "returned"))}) k WHERE abs(s) >= 0.35""",
)
def pattern_skew(spark, sf):
    returned = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned")
    return skew(table(spark, sf, "lineitem").select("l_quantity", returned))


@query(
    "pattern_corr",
    """SELECT kind, subject, round(r, 3) AS strength FROM (
    SELECT 'correlation' AS kind, 'value ~ cubed' AS subject, corr(value, value * value * value) AS r FROM events UNION ALL
    SELECT 'correlation', 'value ~ user_id', corr(value, user_id) FROM events UNION ALL
    SELECT 'correlation', 'cubed ~ user_id', corr(value * value * value, user_id) FROM events) k WHERE abs(r) >= 0.55""",
)
def pattern_corr(spark, sf):
    events = table(spark, sf, "events")
    return strong_pairs(events.select("value", (F.col("value") * F.col("value") * F.col("value")).alias("cubed"), "user_id"))


@query(
    "pattern_rare",
    """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'rare' AS kind, 'o_custkey=' || o_custkey AS subject, round(100 * n / (SELECT sum(n) FROM g), 2) AS strength
    FROM (SELECT * FROM g ORDER BY n, o_custkey LIMIT 3) t
    WHERE (SELECT count(*) FROM g) >= 5 AND 100 * n / (SELECT sum(n) FROM g) <= 2.0""",
)
def pattern_rare(spark, sf):
    return rare_groups(table(spark, sf, "orders"), "o_custkey")


@query(
    "pattern_concentration",
    """SELECT 'concentration' AS kind, 'lang' AS subject, round(sum(n * n) / (sum(n) * sum(n)), 3) AS strength
    FROM (SELECT lang, count(*)::DOUBLE AS n FROM documents GROUP BY 1) g
    HAVING count(*) >= 2 AND sum(n * n) / (sum(n) * sum(n)) >= 0.18""",
)
def pattern_concentration(spark, sf):
    return concentrated(table(spark, sf, "documents"), "lang")


@query(
    "pattern_missing",
    """SELECT 'missing' AS kind, subject, round(pct, 1) AS strength FROM (
    SELECT 'event_type' AS subject, 100 * count(*) FILTER (event_type = 'error') / count(*) AS pct FROM events UNION ALL
    SELECT 'value', 100 * count(*) FILTER (value < 1) / count(*) FROM events) m WHERE pct >= 10""",
)
def pattern_missing(spark, sf):
    return missing_pattern(
        table(spark, sf, "events").select(
            "event_id", F.expr("nullif(event_type, 'error')").alias("event_type"),
            F.when(F.col("value") >= 1, F.col("value")).alias("value"),
        )
    )


@query(
    "patterns",
    f"""SELECT kind, subject, strength FROM (
    SELECT kind, subject, round(s, 3) AS strength FROM ({_skewed("value", "events")} UNION ALL {_skewed("user_id", "events")}) k
      WHERE abs(s) >= 0.35
    UNION ALL SELECT 'correlation', 'value ~ user_id', round(corr(value, user_id), 3) FROM events
      HAVING abs(corr(value, user_id)) >= 0.55
    UNION ALL SELECT 'concentration', 'event_type', round(sum(n * n) / (sum(n) * sum(n)), 3)
      FROM (SELECT count(*)::DOUBLE AS n FROM events GROUP BY event_type) g HAVING sum(n * n) / (sum(n) * sum(n)) >= 0.18
    UNION ALL SELECT 'rare', 'event_type=' || event_type, round(100 * n / t, 2) FROM (
      SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS c FROM events GROUP BY 1
      ORDER BY n, event_type LIMIT 3) r WHERE c >= 5 AND 100 * n / t <= 2.0) p
    ORDER BY abs(strength) DESC, kind, subject""",
)
def patterns_(spark, sf):
    events = table(spark, sf, "events").select("value", "user_id", "event_type")
    return patterns(events, "event_type", ["value", "user_id"])
