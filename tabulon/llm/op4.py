"""The registered query of repeated word windows."""

from pyspark.sql import functions as F

from tabulon.llm.base import query, table
from tabulon.llm.repeats import remove_repeats

SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
),
earliest AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS at
  FROM windows JOIN earliest USING (x) WHERE first < doc_id
),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM words),
kept AS (
  SELECT each.doc_id, string_agg(CASE WHEN gone.at IS NULL THEN word END, ' ' ORDER BY each.at) AS k, count(gone.at) AS n_removed
  FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.at = each.at GROUP BY each.doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@query("op4_substring_dedup", SQL)
def op4_substring_dedup(spark, folder):
    return remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
