"""The registered query of the n-gram join."""

from tabulon.llm.base import query, table
from tabulon.llm.ngram_join import similar_documents


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
named AS (SELECT doc_id, hash(g) AS g FROM grams),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM named a JOIN named b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least_of AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


@query("op1_ngram_join", SQL)
def op1_ngram_join(spark, folder):
    return similar_documents(table(spark, folder, "documents"))
