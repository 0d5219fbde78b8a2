"""Joins of every kind."""

from pyspark.sql import functions as F

from tabulon.operators.joins import join_preview, join_sample, join_tables
from tabulon.operators.samples import head_sample
from tabulon.registry.base import query, table


@query(
    "join_inner",
    """SELECT o_orderkey, o_totalprice, c_custkey AS o_custkey, c_name, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_inner(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return join_tables(orders, customers, ["o_custkey"], ["c_custkey"], "inner")


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars")


@query(
    "join_left",
    "SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def join_left(spark, sf):
    return join_tables(_documents(spark, sf), table(spark, sf, "labels"), ["doc_id"], how="left")


@query(
    "join_right",
    "SELECT quality, toxic, d.doc_id, lang, n_chars FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id",
)
def join_right(spark, sf):
    return join_tables(table(spark, sf, "labels"), _documents(spark, sf), ["doc_id"], how="right")


@query(
    "join_full",
    """SELECT l.doc_id, l.quality, l.toxic, p.doc_id AS doc_id_r, p.quality AS quality__right, p.url
    FROM labels l FULL JOIN (SELECT page_id AS doc_id, 1 AS quality, url FROM pages) p ON l.doc_id = p.doc_id""",
)
def join_full(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.lit(1).alias("quality"), "url"
    )
    return join_tables(table(spark, sf, "labels"), pages, ["doc_id"], how="full")


@query(
    "join_semi",
    "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def join_semi(spark, sf):
    return join_tables(_documents(spark, sf), table(spark, sf, "labels"), ["doc_id"], how="semi")


@query(
    "join_anti",
    "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def join_anti(spark, sf):
    return join_tables(_documents(spark, sf), table(spark, sf, "labels"), ["doc_id"], how="anti")


@query(
    "join_multi_key",
    """SELECT r.l_orderkey, r.l_partkey, r.l_suppkey, r.l_quantity, a.l_orderkey AS other_order
    FROM lineitem r JOIN lineitem a ON r.l_partkey = a.l_partkey AND r.l_suppkey = a.l_suppkey
    WHERE r.l_returnflag = 'R' AND a.l_returnflag = 'A'""",
)
def join_multi_key(spark, sf):
    lines = table(spark, sf, "lineitem")
    returned = lines.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    accepted = lines.filter("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("other_order"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")
    )
    return join_tables(returned, accepted, ["l_partkey", "l_suppkey"], ["part", "supplier"])


@query(
    "join_overlap",
    """SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_name AS n_name__right, b.n_regionkey AS n_regionkey__right
    FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey""",
)
def join_overlap(spark, sf):
    return join_tables(table(spark, sf, "nation"), table(spark, sf, "nation"), ["n_nationkey"])


@query(
    "join_preview",
    """SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows,
    (SELECT count(*) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) AS joined_rows,
    'doc_id,lang,n_chars,quality,toxic' AS columns""",
)
def join_preview_(spark, sf):
    return join_preview(_documents(spark, sf), table(spark, sf, "labels"), ["doc_id"], how="left")


@query(
    "join_preview_keys",
    """SELECT (SELECT count(*) FROM lineitem) AS left_rows, (SELECT count(*) FROM events) AS right_rows,
    (SELECT CAST(sum(l.n * e.n) AS BIGINT) FROM
        (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l JOIN
        (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) e USING (k)) AS joined_rows,
    'l_suppkey,l_quantity,event_type' AS columns""",
)
def join_preview_keys(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity")
    events = table(spark, sf, "events").select("user_id", "event_type")
    return join_preview(lines, events, ["l_suppkey"], ["user_id"], "inner")


def _sample_sql(table_sql: str, columns: list[str], rows: int) -> str:
    fields = ", ".join(f"'{c}': {c}" for c in columns)
    names = ", ".join(columns)
    return f"SELECT {names} FROM ({table_sql}) t ORDER BY md5(CAST(to_json({{{fields}}}) AS VARCHAR)), {names} LIMIT {rows}"


SAMPLED = ["o_orderkey", "o_custkey", "o_orderpriority"]


@query("head_sample", _sample_sql("SELECT * FROM orders", SAMPLED, 50))
def head_sample_(spark, sf):
    return head_sample(table(spark, sf, "orders").select(*SAMPLED), 50)


JOINED = ["o_orderkey", "o_custkey", "c_mktsegment"]


@query(
    "join_sample",
    _sample_sql("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey", JOINED, 200),
)
def join_sample_(spark, sf):
    orders, customers = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return join_sample(join_tables(orders, customers, ["o_custkey"], ["c_custkey"]).select(*JOINED), 200)
