"""Files written and read back, derived tables, upserts, equal content."""

from datetime import datetime

from pyspark.sql import functions as F

from tabulon.functions.schema import columns_meta
from tabulon.operators.cleaning import CleaningPlan, clean_table
from tabulon.operators.explore import run_plan
from tabulon.operators.profile import missing_counts
from tabulon.operators.report import build_report
from tabulon.plans.specs import Plan, QuerySpec
from tabulon.registry.base import query, scratch_path, table
from tabulon.sources.readers import content_duplicates, drop_content_duplicates, read_csv, read_json, read_table
from tabulon.sources.writers import (
    log_query, save_derived, upsert, upsert_counts, write_csv, write_query_json, write_tables,
)

ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority,
    strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders"""


# Rows of one JSON array, and so of one file that is read as a whole.
ARRAY_ROWS = 10_000


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
    )


@query("scan_csv", ORDERS_SQL)
def scan_csv(spark, sf):
    path = scratch_path(spark, "orders") + ".csv"
    write_csv(_orders(spark, sf), path)
    return read_table(spark, path)


@query("scan_tsv", ORDERS_SQL)
def scan_tsv(spark, sf):
    path = scratch_path(spark, "orders") + ".tsv"
    _orders(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return read_table(spark, path)


@query("scan_json", ORDERS_SQL)
def scan_json(spark, sf):
    path = scratch_path(spark, "orders") + ".json"
    _orders(spark, sf).write.json(path)
    return read_table(spark, path)


@query("scan_json_array", ORDERS_SQL)
def scan_json_array(spark, sf):
    """The same rows as JSON arrays of bounded length, each in a file of its own."""
    path = scratch_path(spark, "orders")
    line = F.to_json(F.struct(*[F.col(c) for c in _orders(spark, sf).columns])).alias("line")
    # Ids count the rows of each task, so that no array holds more than ARRAY_ROWS, whatever the rows hold.
    numbered = _orders(spark, sf).select(line, F.floor(F.monotonically_increasing_id() / ARRAY_ROWS).alias("part"))
    listed = numbered.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("line"), ","), F.lit("]")).alias("value"))
    listed.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json(spark, path).select(*_orders(spark, sf).columns)


@query("scan_parquet", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def scan_parquet(spark, sf):
    return read_table(spark, f"{sf}/part.parquet")


@query(
    "columns_meta",
    """SELECT * FROM (SELECT 0 AS position, 'o_orderkey' AS name, 'number' AS kind, count(*) - count(o_orderkey) AS missing FROM orders
    UNION ALL SELECT 1, 'o_custkey', 'number', count(*) - count(o_custkey) FROM orders
    UNION ALL SELECT 2, 'o_orderstatus', 'string', count(*) FILTER (o_orderstatus = 'P') FROM orders
    UNION ALL SELECT 3, 'o_totalprice', 'number', count(*) - count(o_totalprice) FROM orders
    UNION ALL SELECT 4, 'o_orderdate', 'datetime', count(*) - count(o_orderdate) FROM orders
    UNION ALL SELECT 5, 'o_orderpriority', 'string', count(*) - count(o_orderpriority) FROM orders) m""",
)
def columns_meta_(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    described = columns_meta(orders).drop("dtype")
    missing = missing_counts(orders).select(F.col("column").alias("name"), "missing")
    return described.join(missing, "name")


@query(
    "content_duplicates",
    """SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies,
    doc_id <> min(doc_id) OVER w AS is_duplicate FROM documents WINDOW w AS (PARTITION BY text)""",
)
def content_duplicates_(spark, sf):
    return content_duplicates(table(spark, sf, "documents"), "doc_id", "text")


FEW_TEXTS = "(SELECT doc_id, lang, CASE WHEN lang = 'de' THEN NULL ELSE text END AS text FROM documents)"


def _few_texts(spark, sf):
    text = F.when(F.col("lang") != "de", F.col("text")).alias("text")
    return table(spark, sf, "documents").select("doc_id", "lang", text)


@query(
    "content_duplicates_null",
    f"""SELECT doc_id, sha256(text) AS content_hash, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER w END AS first_id,
    CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER w END AS copies,
    text IS NOT NULL AND doc_id <> min(doc_id) OVER w AS is_duplicate FROM {FEW_TEXTS} t WINDOW w AS (PARTITION BY text)""",
)
def content_duplicates_null(spark, sf):
    return content_duplicates(_few_texts(spark, sf), "doc_id", "text")


@query(
    "drop_content_duplicates_null",
    f"""SELECT doc_id, lang, text FROM {FEW_TEXTS} t
    WHERE text IS NULL OR doc_id IN (SELECT min(doc_id) FROM {FEW_TEXTS} u GROUP BY text)""",
)
def drop_content_duplicates_null(spark, sf):
    return drop_content_duplicates(_few_texts(spark, sf), "doc_id", "text")


TEXTS_SQL = """SELECT doc_id, concat('"', text, '", ', lang) AS text, lang, n_chars FROM documents"""


@query("sink_csv_text", TEXTS_SQL)
def sink_csv_text(spark, sf):
    """Texts with quotes, commas and line breaks, written and read back."""
    path = scratch_path(spark, "documents") + ".csv"
    text = F.concat(F.lit('"'), "text", F.lit('", '), "lang").alias("text")
    write_csv(table(spark, sf, "documents").select("doc_id", text, "lang", "n_chars"), path)
    return read_table(spark, path, schema="doc_id long, text string, lang string, n_chars long")


@query("scan_csv_text", "SELECT doc_id, text, n_chars FROM documents")
def scan_csv_text(spark, sf):
    """Lines in standard quoting, made without the CSV writer."""
    path = scratch_path(spark, "documents") + ".csv"
    quoted = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", "doc_id", quoted, "n_chars").alias("value")
    table(spark, sf, "documents").select(line).write.text(path)
    schema = "doc_id long, text string, n_chars long"
    return read_csv(spark, path, schema=schema, header=False)


@query(
    "drop_content_duplicates",
    "SELECT doc_id, lang, text FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)",
)
def drop_content_duplicates_(spark, sf):
    return drop_content_duplicates(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id", "text")


@query(
    "sink_csv",
    "SELECT event_id, nullif(event_type, 'error') AS event_type, value FROM events",
)
def sink_csv(spark, sf):
    path = scratch_path(spark, "events") + ".csv"
    events = table(spark, sf, "events").select(
        "event_id", F.expr("nullif(event_type, 'error')").alias("event_type"), "value"
    )
    write_csv(events, path)
    return read_table(spark, path, schema="event_id long, event_type string, value double")


@query(
    "sink_json",
    """SELECT l_returnflag, l_suppkey, count(*) AS rows, max(l_quantity) AS l_quantity__max,
    (SELECT count(*) FROM lineitem) AS source_rows, (SELECT count(*) FROM lineitem WHERE l_quantity > 25) AS filtered_rows
    FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2""",
)
def sink_json(spark, sf):
    spec = QuerySpec(
        mode="grouped",
        filters=[{"column": "l_quantity", "op": "gt", "value": 25}],
        group_by=["l_returnflag", "l_suppkey"],
        aggregations=[{"column": "*", "agg": "count", "alias": "rows"}, {"column": "l_quantity", "agg": "max"}],
    )
    path = scratch_path(spark, "groups")
    meta = write_query_json(table(spark, sf, "lineitem"), spec, path)
    return spark.read.json(f"{path}/rows").withColumns(
        {"source_rows": F.lit(meta["source_rows"]).cast("long"), "filtered_rows": F.lit(meta["filtered_rows"]).cast("long")}
    )


@query(
    "save_derived",
    """SELECT 'etl' AS type, 'documents' AS sources, 'clean_missing:drop,remove_duplicates,normalize_strings' AS steps,
    (SELECT count(*) FROM documents) AS rows_before,
    (SELECT count(*) FROM (SELECT DISTINCT lang, source, text FROM documents) d) AS rows_after""",
)
def save_derived_(spark, sf):
    path = scratch_path(spark, "cleaned")
    before = table(spark, sf, "documents").select("lang", "source", "text")
    cleaned, steps = clean_table(before, CleaningPlan())
    save_derived(cleaned, path, "etl", ["documents"], steps, before.count())
    lineage = spark.read.json(f"{path}/lineage")
    return lineage.select(
        "type", F.array_join("sources", ",").alias("sources"), F.array_join("steps", ",").alias("steps"),
        "rows_before", "rows_after",
    )


@query("report_tables")
def report_tables(spark, sf):
    path = scratch_path(spark, "report")
    write_tables(build_report(table(spark, sf, "customer"), "executive", ["c_mktsegment"]), path)
    return spark.read.json(path)


@query(
    "query_log",
    """SELECT 'orders by priority' AS question, count(*) AS row_count, 'o_orderpriority,count' AS columns
    FROM (SELECT DISTINCT o_orderpriority FROM orders) o""",
)
def query_log(spark, sf):
    path = scratch_path(spark, "log")
    plan = Plan(group_by=["o_orderpriority"])
    result = run_plan(table(spark, sf, "orders"), plan)
    log_query(result, "orders by priority", plan, path, datetime(2024, 1, 1))
    return spark.read.json(path).select("question", "row_count", F.array_join("columns", ",").alias("columns"))


@query(
    "upsert",
    """SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')
    UNION ALL SELECT doc_id, 1, 0 FROM documents WHERE lang = 'de'""",
)
def upsert_(spark, sf):
    return upsert(table(spark, sf, "labels"), _changes(spark, sf), ["doc_id"])


def _changes(spark, sf):
    return table(spark, sf, "documents").filter("lang = 'de'").select(
        "doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")
    )


@query(
    "upsert_counts",
    """SELECT count(*) FILTER (l.doc_id IS NULL) AS inserted, count(*) FILTER (l.doc_id IS NOT NULL) AS updated
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'de'""",
)
def upsert_counts_(spark, sf):
    return upsert_counts(table(spark, sf, "labels"), _changes(spark, sf), ["doc_id"])
