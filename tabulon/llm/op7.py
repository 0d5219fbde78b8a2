"""The registered query of the fixity audit."""

from pyspark.sql import functions as F

from tabulon.llm.base import query, table
from tabulon.llm.fixity import audit

SQL = r"""
WITH original AS (SELECT page_id, url, html FROM pages),
replica AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 3 THEN concat(html, '#') ELSE html END AS html
  FROM pages WHERE page_id % 211 <> 5
  UNION ALL SELECT -page_id - 1, url, html FROM pages WHERE page_id % 307 = 7
),
a AS (
  SELECT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
    'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS r FROM original
),
b AS (
  SELECT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
    'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS r FROM replica
),
both_copies AS (
  SELECT coalesce(a.page_id, b.page_id) AS page_id, a.page_id IS NULL AS added, b.page_id IS NULL AS missing,
    strlen(a.r) AS length, sha256(a.r) AS x, sha256(b.r) AS y
  FROM a FULL JOIN b ON a.page_id = b.page_id
),
placed AS (
  SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM both_copies
)
SELECT page_id, CASE WHEN missing THEN 'missing' WHEN added THEN 'added' ELSE 'changed' END AS status,
  "offset", length, x AS sha256, y AS replica_sha256
FROM placed WHERE x IS DISTINCT FROM y
"""


@query("op7_warc_fixity", SQL)
def op7_warc_fixity(spark, folder):
    """The pages against a copy with changed, lost and added records."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    changed = F.when(F.col("page_id") % 97 == 3, F.concat("html", F.lit("#"))).otherwise(F.col("html"))
    replica = pages.where(F.col("page_id") % 211 != 5).select("page_id", "url", changed.alias("html"))
    added = pages.where(F.col("page_id") % 307 == 7).select((-F.col("page_id") - 1).alias("page_id"), "url", "html")
    return audit(pages, replica.unionAll(added))
