"""Lexical, vector and hybrid search."""

from pyspark.sql import functions as F

from tabulon.operators.chunkstore import brief_context, hit_sources, retrieved_context
from tabulon.operators.lexical import bm25, index_documents, search_index
from tabulon.operators.vectors import embed, hybrid_search, vector_topk
from tabulon.registry.base import query, scratch_path, table, texts

WORDS = "list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1)"


def bm25_ctes(documents: str, queries: str = "benchmark", title: str | None = None) -> str:
    """CTEs up to ``scored(item_id, doc_id, score)``."""
    body = "text" if title is None else f"{title} || ' ' || text"
    titled = "" if title is None else f"""
      UNION ALL SELECT item_id, doc_id, 2.0 FROM q JOIN d ON contains(lower(title), array_to_string(qk, ' ')) WHERE len(qk) > 0"""
    return f"""d AS (SELECT doc_id, {WORDS.format(text=body)} AS tk, lower({body}) AS low, {title or "''"} AS title FROM {documents}),
    c AS (SELECT count(*) AS n, greatest(avg(len(tk)), 1) AS mean FROM d),
    tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS t FROM d) u GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    q AS (SELECT item_id, {WORDS.format(text="text")} AS qk FROM {queries}),
    qt AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(qk) AS t FROM q) u),
    hit AS (SELECT item_id, tf.doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
        / (tf + 1.5 * (0.25 + 0.75 * len(tk) / mean)) AS s
      FROM qt JOIN tf USING (t) JOIN df USING (t) JOIN d ON d.doc_id = tf.doc_id CROSS JOIN c
      UNION ALL SELECT item_id, doc_id, 1.5 FROM q JOIN d ON contains(low, array_to_string(qk, ' ')) WHERE len(qk) > 0{titled}),
    scored AS (SELECT item_id, doc_id, round(sum(s), 6) AS score FROM hit GROUP BY ALL)"""


def ranked_sql(scored: str, k: int) -> str:
    return f"""(SELECT item_id AS query_id, doc_id AS id, score, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {scored} WHERE score > 0) r
    WHERE rank <= {k})"""


def _search(spark, documents, sf, k=8, **options):
    return bm25(documents, table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", k, **options)


@query("bm25", f"WITH {bm25_ctes('documents')} SELECT * FROM {ranked_sql('scored', 8)} x")
def bm25_(spark, sf):
    return _search(spark, texts(spark, sf, "documents"), sf)


@query("bm25_stored_index", f"WITH {bm25_ctes('documents')} SELECT * FROM {ranked_sql('scored', 5)} x")
def bm25_stored_index(spark, sf):
    path = scratch_path(spark, "index")
    index_documents(texts(spark, sf, "documents"), "doc_id", "text").write.parquet(path)
    return search_index(spark.read.parquet(path), table(spark, sf, "benchmark"), "item_id", "text", 5)


@query(
    "bm25_filtered",
    f"""WITH {bm25_ctes("(SELECT * FROM documents WHERE lang = 'en') e")} SELECT * FROM {ranked_sql('scored', 8)} x""",
)
def bm25_filtered(spark, sf):
    return _search(spark, texts(spark, sf, "documents").filter("lang = 'en'"), sf)


@query(
    "bm25_titles",
    f"""WITH {bm25_ctes("(SELECT page_id AS doc_id, url AS title, html AS text FROM pages) e",
        "(SELECT DISTINCT n_nationkey AS item_id, source AS text FROM documents JOIN nation ON 'src' || n_nationkey = source UNION ALL SELECT 100 + r_regionkey, 'example com' FROM region) q0", "title")}
    SELECT * FROM {ranked_sql('scored', 5)} x""",
)
def bm25_titles(spark, sf):
    pages = texts(spark, sf, "pages")
    documents, nation = table(spark, sf, "documents"), table(spark, sf, "nation")
    sources = documents.join(nation, F.concat(F.lit("src"), "n_nationkey") == F.col("source"))
    asked = sources.select(F.col("n_nationkey").alias("item_id"), F.col("source").alias("text")).distinct().union(
        table(spark, sf, "region").select(100 + F.col("r_regionkey"), F.lit("example com"))
    )
    return bm25(pages, asked, "page_id", "html", "item_id", "text", 5, titles=["url"])


CENTROIDS = """(SELECT label, list(v ORDER BY pos) AS centre FROM (
    SELECT label, pos, avg(v::DOUBLE) AS v FROM (
      SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) u GROUP BY ALL) m GROUP BY label)"""


def centroids(embeddings):
    """The mean vector of every label."""
    means = embeddings.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(
        F.avg(F.col("col").cast("double")).alias("v")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return means.groupBy("label").agg(F.transform(ordered, lambda e: e["v"]).alias("centre"))


@query(
    "vector_topk",
    f"""SELECT query_id, id, round(greatest(near, 0), 4) AS score, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, id) AS rank FROM (
      SELECT label_q AS query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 9) AS near
      FROM embeddings CROSS JOIN (SELECT label AS label_q, centre FROM {CENTROIDS} c) q) s) r WHERE rank <= 10""",
)
def vector_topk_(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return vector_topk(vectors, centroids(vectors), "vec_id", "embedding", "label", "centre", 10)


@query(
    "vector_filtered",
    f"""SELECT query_id, id, round(greatest(near, 0), 4) AS score, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, id) AS rank FROM (
      SELECT label_q AS query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 9) AS near
      FROM embeddings CROSS JOIN (SELECT label AS label_q, centre FROM {CENTROIDS} c) q WHERE vec_id % 7 <> 3) s) r WHERE rank <= 10""",
)
def vector_filtered(spark, sf):
    """Some vectors only, the others null or with NaN in them."""
    vectors = table(spark, sf, "embeddings")
    broken = F.when(F.col("vec_id") % 2 == 0, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float")))
    kept = F.when(F.col("vec_id") % 7 == 3, broken).otherwise(F.col("embedding")).alias("embedding")
    return vector_topk(vectors.select("vec_id", kept), centroids(vectors), "vec_id", "embedding", "label", "centre", 10)


@query("embed_hash")
def embed_hash(spark, sf):
    return embed(texts(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


HELD = "(SELECT d.doc_id, d.text, e.embedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id{where})"
ASKED = "(SELECT b.item_id, b.text, e.embedding FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id)"


def _hybrid_sql(where: str = "") -> str:
    held = HELD.format(where=where)
    return f"""WITH {bm25_ctes(held + ' h', ASKED + ' a')},
    k AS (SELECT * FROM {ranked_sql('scored', 32)} x),
    v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, id) AS rank FROM (
      SELECT item_id AS query_id, doc_id AS id, round(list_cosine_similarity(h.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS near
      FROM {held} h CROSS JOIN {ASKED} a WHERE h.embedding IS NOT NULL) s) r WHERE rank <= 32),
    m AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id, CAST(v.rank AS INT) AS vector_rank,
      CAST(k.rank AS INT) AS keyword_rank, coalesce(round(greatest(near, 0), 4), 0) AS vector_score, coalesce(k.score, 0) AS keyword_score,
      round(coalesce(0.65 / (60 + v.rank), 0) + coalesce(0.35 / (60 + k.rank), 0), 6) AS score
      FROM v FULL JOIN k ON v.query_id = k.query_id AND v.id = k.id)
    SELECT query_id, id, vector_rank, keyword_rank, vector_score, keyword_score, score, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m) f WHERE rank <= 8"""


def _hybrid(spark, sf, documents):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    held = documents.join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    asked = table(spark, sf, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id"))
    return hybrid_search(held, asked, "doc_id", "text", "embedding", "item_id", "text", "embedding")


@query("hybrid_rrf", _hybrid_sql())
def hybrid_rrf(spark, sf):
    """All documents, also those without a vector."""
    return _hybrid(spark, sf, texts(spark, sf, "documents"))


@query("hybrid_filtered", _hybrid_sql(" WHERE d.lang = 'en'"))
def hybrid_filtered(spark, sf):
    return _hybrid(spark, sf, texts(spark, sf, "documents").filter("lang = 'en'"))


def _context_sql(select: str) -> str:
    return f"""WITH {bm25_ctes('documents')}, k AS (SELECT * FROM {ranked_sql('scored', 3)} x) {select}"""


def _hits(spark, sf):
    documents = texts(spark, sf, "documents")
    return _search(spark, documents, sf, 3), documents


@query(
    "rag_context",
    _context_sql("""SELECT query_id, count(*) AS sources, string_agg('[' || rank || '] (' || source || ')' || chr(10) || text,
      chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM k JOIN documents ON doc_id = id GROUP BY 1"""),
)
def rag_context(spark, sf):
    return retrieved_context(*_hits(spark, sf), "doc_id", "text", "source")


@query(
    "rag_brief_context",
    _context_sql("""SELECT query_id, count(*) AS sources, string_agg('[K' || rank || '] ' || doc_id || chr(10) || substring(text, 1, 1200),
      chr(10) || chr(10) ORDER BY rank) AS context FROM k JOIN documents ON doc_id = id GROUP BY 1"""),
)
def rag_brief_context(spark, sf):
    return brief_context(*_hits(spark, sf), "doc_id")


@query(
    "rag_sources",
    _context_sql("""SELECT query_id, rank, id AS chunk_id, source AS title, score, substring(text, 1, 240) AS preview
      FROM k JOIN documents ON doc_id = id"""),
)
def rag_sources(spark, sf):
    return hit_sources(*_hits(spark, sf), "doc_id", "text", "source")
