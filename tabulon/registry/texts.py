"""Chunking and the chunk table."""

from pyspark.sql import functions as F

from tabulon.functions.temporal import as_datetime
from tabulon.functions.text import flat_metadata, keywords, numbers, truncate_cell
from tabulon.operators.chunking import (
    chunk_context, chunk_documents, lines_to_documents, rows_to_lines, size_flags,
)
from tabulon.operators.chunkstore import (
    chunk_stats, cut_repeats, delete_rows, linked_documents, reconcile, replace_documents, update_chunks,
)
from tabulon.operators.lexical import list_chunks
from tabulon.registry.base import query, scratch_path, table, texts

# White space as Unicode and text tools know it; the SQL dialect's own class knows ASCII only.
SPACES = r"\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def chunk_sql(source: str) -> str:
    """Chunks of texts without blank lines: windows of 900 characters, 780 apart."""
    return f"""(SELECT doc_id || '-' || chunk_index AS chunk_id, doc_id, chunk_index, text,
      length(text) AS char_count, len(regexp_extract_all(text, '[^{SPACES}]+')) AS word_count
    FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, text
      FROM (SELECT doc_id, i, {strip_sql("substring(body, CAST(i * 780 + 1 AS BIGINT), 900)")} AS text
        FROM (SELECT doc_id, body, unnest(range(0, CAST(ceil(greatest(length(body) - 900, 0) / 780) AS BIGINT) + 1)) AS i
          FROM (SELECT doc_id, {strip_sql("text")} AS body FROM {source}) a) b) c WHERE text <> '') d)"""


CHUNKS = chunk_sql("documents")


def chunks_of(spark, sf):
    return chunk_documents(texts(spark, sf, "documents"), "doc_id", "text")


def stored_chunks(spark, sf):
    """The chunks as a stored table, the way an index keeps them."""
    path = scratch_path(spark, "chunks")
    chunks_of(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


@query("chunk_text", f"SELECT * FROM {CHUNKS} c")
def chunk_text(spark, sf):
    return chunks_of(spark, sf)


def packed_sql(prefix: str = "") -> str:
    """Every line as a paragraph, packed up to 900 characters; a long one cut into windows.
    Every line but the first starts with ``prefix``."""
    line = strip_sql(f"CASE WHEN i > 1 THEN '{prefix}' ELSE '' END || line")
    return f"""WITH RECURSIVE p AS (
  SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
    SELECT doc_id, i, {line} AS para FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM documents) a) b WHERE para <> ''),
r AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS pos, '' AS buf, CAST([] AS VARCHAR[]) AS done FROM p
  UNION ALL
  SELECT r.doc_id, p.pos,
    CASE WHEN length(para) > 900 THEN '' WHEN buf = '' THEN para
      WHEN length(buf) + 2 + length(para) <= 900 THEN buf || chr(10) || chr(10) || para ELSE para END,
    CASE WHEN length(para) > 900 THEN list_concat(list_concat(done, CASE WHEN buf <> '' THEN [buf] ELSE [] END),
        list_filter(list_transform(range(0, CAST(ceil((length(para) - 900) / 780) AS BIGINT) + 1),
          lambda i: {strip_sql("substring(para, CAST(i * 780 + 1 AS BIGINT), 900)")}), lambda x: x <> ''))
      WHEN buf <> '' AND length(buf) + 2 + length(para) > 900 THEN list_append(done, buf) ELSE done END
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.pos = r.pos + 1),
f AS (SELECT doc_id, CASE WHEN buf <> '' THEN list_append(done, buf) ELSE done END AS done FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS rn FROM r) l WHERE rn = 1)
SELECT doc_id, unnest(done) AS text, generate_subscripts(done, 1) - 1 AS chunk_index FROM f"""


def _spaced(spark, sf, prefix=""):
    """The documents with every line as a paragraph of its own."""
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n" + prefix))
    return texts(spark, sf, "documents").select("doc_id", spaced.alias("text"))


@query("chunk_paragraphs", packed_sql())
def chunk_paragraphs(spark, sf):
    return chunk_documents(_spaced(spark, sf), "doc_id", "text").select("doc_id", "text", "chunk_index")


def sections_sql(chunks: str) -> str:
    """Section title and level of every chunk, carried on within its document."""
    mark = f"^#{{1,6}}[{SPACES}]+"
    return f"""WITH k AS ({chunks}), first AS (SELECT *, {strip_sql("string_split(text, chr(10))[1]")} AS line FROM k),
m AS (SELECT *, CASE WHEN regexp_matches(line, '{mark}.') THEN {strip_sql(f"regexp_replace(line, '{mark}', '')")}
    WHEN length(line) < 120 AND line = upper(line) AND regexp_matches(line, '[A-ZА-ЯЁ]') THEN line END AS title,
  CASE WHEN regexp_matches(line, '{mark}.') THEN length(regexp_extract(line, '^#+')) END AS level FROM first)
SELECT doc_id, chunk_index, last_value(title IGNORE NULLS) OVER w AS section_title, last_value(level IGNORE NULLS) OVER w AS section_level
FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _sections(described):
    return described.select("doc_id", "chunk_index", "metadata.section_title", "metadata.section_level")


@query("chunk_sections", sections_sql(packed_sql("## ")))
def chunk_sections(spark, sf):
    """Lines as headings: chunks cut from a long line carry its title on."""
    return _sections(chunk_documents(_spaced(spark, sf, "## "), "doc_id", "text", context=True))


@query("chunk_context", sections_sql(packed_sql("# ")))
def chunk_context_(spark, sf):
    """The same for a stored chunk table."""
    path = scratch_path(spark, "headed")
    chunk_documents(_spaced(spark, sf, "# "), "doc_id", "text").write.parquet(path)
    return _sections(chunk_context(spark.read.parquet(path), "doc_id"))


@query("chunk_metadata")
def chunk_metadata(spark, sf):
    described = chunk_documents(texts(spark, sf, "documents"), "doc_id", "text", context=True)
    flat = flat_metadata(described, "metadata")
    return described.select("chunk_id", F.to_json(flat).alias("metadata"))


@query(
    "chunk_keywords",
    f"""SELECT chunk_id, coalesce(array_to_string(list(t ORDER BY pos), ' '), '') AS keywords FROM {CHUNKS} c LEFT JOIN (
      SELECT chunk_id AS cid, t, min(pos) AS pos FROM (
        SELECT chunk_id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (
          SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {CHUNKS} c2) a) b
      WHERE length(t) > 3 AND NOT regexp_full_match(t, '\\p{{Nd}}+') GROUP BY 1, 2) k ON chunk_id = cid GROUP BY chunk_id""",
)
def chunk_keywords(spark, sf):
    return chunks_of(spark, sf).select("chunk_id", F.array_join(keywords(F.col("text")), " ").alias("keywords"))


ROW_LINES = """(SELECT row_number() OVER (ORDER BY p_partkey) AS row_number,
    'Row ' || row_number() OVER (ORDER BY p_partkey) || ': p_partkey: ' || p_partkey || ' | p_name: ' || p_name
    || ' | p_type: ' || coalesce(nullif(p_type, 'SMALL'), '—') || ' | p_retailprice: ' || printf('%.4g', p_retailprice) AS line FROM part)"""


def _lines(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", "p_name", F.expr("nullif(p_type, 'SMALL')").alias("p_type"), "p_retailprice"
    )
    return rows_to_lines(parts, ["p_partkey"])


@query("rows_to_text", f"SELECT * FROM {ROW_LINES} l")
def rows_to_text(spark, sf):
    return _lines(spark, sf)


@query(
    "rows_to_documents",
    f"""SELECT (row_number - 1) // 5000 AS document, string_agg(line, chr(10) ORDER BY row_number) AS text, count(*) AS rows
    FROM {ROW_LINES} l GROUP BY 1""",
)
def rows_to_documents(spark, sf):
    return lines_to_documents(_lines(spark, sf))


@query(
    "chunk_cap",
    f"""SELECT doc_id, strlen(text) AS text_bytes, coalesce(n, 0) AS chunks, strlen(text) > 10000 AS too_many_bytes,
    coalesce(n, 0) > 10 AS too_many_chunks FROM documents LEFT JOIN
    (SELECT doc_id, count(*) AS n FROM {CHUNKS} c GROUP BY 1) k USING (doc_id)""",
)
def chunk_cap(spark, sf):
    return size_flags(texts(spark, sf, "documents"), "doc_id", "text", 10_000, 10)


@query(
    "chunk_stats",
    f"""SELECT count(*) AS chunks_total, count(DISTINCT doc_id) AS documents_indexed, round(avg(char_count), 1) AS avg_chunk_chars
    FROM {CHUNKS} c""",
)
def chunk_stats_(spark, sf):
    return chunk_stats(chunks_of(spark, sf), "doc_id")


def _changed(chunks):
    """The last chunk of every document, marked as new."""
    last = chunks.groupBy("doc_id").agg(F.max_by(F.struct("chunk_id", "text"), "chunk_index").alias("c"))
    return last.select("c.chunk_id", F.concat(F.lit("new "), "c.text").alias("text"))


@query(
    "chunk_upsert",
    f"""SELECT chunk_id, doc_id, chunk_index, t AS text, length(t) AS char_count,
      len(regexp_extract_all(t, '[^{SPACES}]+')) AS word_count FROM (
      SELECT *, CASE WHEN chunk_index = max(chunk_index) OVER (PARTITION BY doc_id) THEN 'new ' || text ELSE text END AS t
      FROM {CHUNKS} c) u""",
)
def chunk_upsert(spark, sf):
    chunks = stored_chunks(spark, sf)
    return update_chunks(chunks, _changed(chunks))


@query(
    "chunk_delete",
    f"""SELECT chunk_id, doc_id, chunk_index, char_count FROM (
    SELECT *, max(chunk_index) OVER (PARTITION BY doc_id) AS top FROM {CHUNKS} c) t WHERE chunk_index < top""",
)
def chunk_delete(spark, sf):
    chunks = stored_chunks(spark, sf)
    kept = delete_rows(chunks, _changed(chunks), "chunk_id")
    return kept.select("chunk_id", "doc_id", "chunk_index", "char_count")


@query(
    "chunk_delete_documents",
    f"""SELECT chunk_id, doc_id, char_count FROM {CHUNKS} c WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def chunk_delete_documents(spark, sf):
    kept = delete_rows(stored_chunks(spark, sf), table(spark, sf, "labels"), "doc_id")
    return kept.select("chunk_id", "doc_id", "char_count")


@query(
    "reindex_swap",
    f"""SELECT chunk_id, doc_id, chunk_index, text, char_count, word_count FROM {CHUNKS} c
      WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')
    UNION ALL SELECT * FROM {chunk_sql("(SELECT doc_id, 'Titre: ' || text AS text FROM documents WHERE lang = 'fr') f")} n""",
)
def reindex_swap(spark, sf):
    changed = texts(spark, sf, "documents").filter("lang = 'fr'").withColumn("text", F.concat(F.lit("Titre: "), "text"))
    return replace_documents(stored_chunks(spark, sf), chunk_documents(changed, "doc_id", "text"), "doc_id", changed)


@query(
    "index_reconcile",
    """SELECT coalesce(d.doc_id, e.vec_id) AS id,
    CASE WHEN e.vec_id IS NULL THEN 'missing_vector' ELSE 'orphan_vector' END AS status
    FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.doc_id IS NULL OR e.vec_id IS NULL""",
)
def index_reconcile(spark, sf):
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return reconcile(documents, table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), "id")


@query(
    "linked_documents",
    f"""SELECT source, doc_id, count(*) AS chunk_count FROM {CHUNKS} c JOIN documents d USING (doc_id)
    WHERE source IN (SELECT source FROM documents WHERE lang = 'de') GROUP BY 1, 2""",
)
def linked_documents_(spark, sf):
    documents = texts(spark, sf, "documents")
    chunks = chunk_documents(documents, "doc_id", "text", keep=["source"])
    tables = documents.filter("lang = 'de'").select(F.col("source").alias("table_id"))
    return linked_documents(tables, chunks, "table_id", "source", "doc_id")


LISTED = """(SELECT chunk_id, CAST(2 * ((length(h) - length(replace(h, 'the of', ''))) / 6) AS BIGINT)
      + contains(h, 'the')::INT + contains(h, 'of')::INT AS score FROM (
      SELECT chunk_id, lower(text) AS h FROM {chunks} c) t)"""


@query(
    "chunk_keyword_list",
    f"""SELECT chunk_id, score, (SELECT count(*) FROM {LISTED.format(chunks=CHUNKS)} n WHERE score > 0) AS total
    FROM {LISTED.format(chunks=CHUNKS)} l WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 100 OFFSET 20""",
)
def chunk_keyword_list(spark, sf):
    return list_chunks(stored_chunks(spark, sf), "The of", "chunk_id", 100, 20).select("chunk_id", "score", "total")


REPEATS = f"""WITH p AS (
  SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
    SELECT doc_id, i, {strip_sql("line")} AS para FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM documents) a) b WHERE para <> ''),
n AS (SELECT doc_id, pos, para, lower(regexp_replace(para, '[{SPACES}]+', ' ', 'g')) AS norm FROM p),
h AS (SELECT b.doc_id, min(b.pos) AS pos FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.pos < b.pos
  WHERE a.norm = b.norm OR (length(a.norm) <= length(b.norm) AND length(a.norm) > 50 AND contains(b.norm, a.norm))
    OR (length(b.norm) < length(a.norm) AND length(b.norm) > 50 AND contains(a.norm, b.norm)) GROUP BY 1)
SELECT n.doc_id, string_agg(para, chr(10) ORDER BY n.pos) FILTER (h.pos IS NULL OR n.pos < h.pos) AS text,
  count(*) AS paragraphs, count(*) FILTER (h.pos IS NULL OR n.pos < h.pos) AS kept_paragraphs
FROM n LEFT JOIN h ON h.doc_id = n.doc_id GROUP BY n.doc_id"""


@query("dedupe_paragraphs", REPEATS)
def dedupe_paragraphs(spark, sf):
    """Every line is a paragraph here, since the texts have no blank lines."""
    documents = texts(spark, sf, "documents").select("doc_id", "text")
    return cut_repeats(documents, "text", r"\n", "\n").filter("paragraphs > 0")


@query("truncated_cells", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 79) || '…' ELSE text END AS cell FROM documents")
def truncated_cells(spark, sf):
    return table(spark, sf, "documents").select("doc_id", truncate_cell(F.col("text")).alias("cell"))


NUMBERED = "'no ' || o_orderkey || '.' || o_custkey || ', customer (' || o_custkey || '); ' || o_orderkey || ',5 of ' || o_orderpriority"


@query("text_numbers", f"SELECT o_orderkey, array_to_string(regexp_extract_all({NUMBERED}, '[0-9]+(?:[.,][0-9]+)?'), '|') AS numbers FROM orders")
def text_numbers(spark, sf):
    """All numbers of a line, with at most one decimal part each."""
    key, customer = (F.col(c).cast("string") for c in ("o_orderkey", "o_custkey"))
    line = F.concat(F.lit("no "), key, F.lit("."), customer, F.lit(", customer ("), customer, F.lit("); "), key, F.lit(",5 of "), "o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(numbers(line), "|").alias("numbers"))


@query(
    "dates_given_as_text",
    """SELECT o_orderkey, strftime(TRY_CAST(CASE o_orderkey % 4 WHEN 0 THEN 'no date' WHEN 1 THEN NULL WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
    ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 13:05:09' END AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed FROM orders""",
)
def dates_given_as_text(spark, sf):
    """Text that is no date becomes null, with or without a time of day."""
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    given = F.when(kind == 0, "no date").when(kind == 2, day).when(kind == 3, F.concat(day, F.lit(" 13:05:09")))
    orders = table(spark, sf, "orders").select("o_orderkey", given.alias("given"))
    return orders.select("o_orderkey", F.date_format(as_datetime(orders, "given"), "yyyy-MM-dd HH:mm:ss").alias("parsed"))
