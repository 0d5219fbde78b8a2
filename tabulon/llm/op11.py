"""The registered query of the Merkle manifest."""

from pyspark.sql import functions as F

from tabulon.llm.base import query, table
from tabulon.llm.manifest import folded, leaf_hash, manifest, proof_digest

SQL = r"""
WITH RECURSIVE texts AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM (
    SELECT doc_id, source, lang, n_chars, text, CASE WHEN doc_id IS NOT NULL THEN {crc} END AS crc FROM documents)
),
leaves AS (
  SELECT doc_id, source,
    sha256(concat({head}, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END)) AS leaf,
    sha256(concat({head}, CASE WHEN changed IS NULL THEN '-' ELSE strlen(changed) || ':' || changed END)) AS shown
  FROM texts
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM leaves),
levels AS (
  SELECT source, 0 AS level, list(leaf ORDER BY slot) AS nodes FROM numbered GROUP BY source
  UNION ALL SELECT source, level + 1, {up} FROM levels WHERE len(nodes) > 1
),
subroots AS (SELECT source, level AS height, nodes[1] AS subroot FROM levels WHERE len(nodes) = 1),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM subroots),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM placed
  UNION ALL SELECT level + 1, {up} FROM tops WHERE len(nodes) > 1
),
root AS (SELECT level AS height, nodes[1] AS root FROM tops WHERE len(nodes) = 1),
steps AS (
  SELECT source, level, pos - 1 AS run, {siblings} FROM (SELECT source, level, nodes, unnest(generate_series(1, len(nodes))) AS pos FROM levels WHERE len(nodes) > 1)
),
top_steps AS (SELECT level, pos - 1 AS run, {siblings} FROM (SELECT level, nodes, unnest(generate_series(1, len(nodes))) AS pos FROM tops WHERE len(nodes) > 1)),
paths AS (
  SELECT n.source, n.slot, s.level, before, after FROM numbered n JOIN steps s ON s.source IS NOT DISTINCT FROM n.source AND s.run = n.slot // CAST(pow(3, s.level) AS BIGINT)
  UNION ALL SELECT n.source, n.slot, p.height + t.level, before, after FROM numbered n JOIN placed p ON p.source IS NOT DISTINCT FROM n.source
    JOIN top_steps t ON t.run = p.place // CAST(pow(3, t.level) AS BIGINT)
),
whole AS (
  SELECT n.doc_id, n.leaf, n.shown, p.subroot, root.root, x.path FROM numbered n JOIN placed p ON p.source IS NOT DISTINCT FROM n.source CROSS JOIN root
  LEFT JOIN (SELECT source, slot, list({{'b': before, 'a': after}} ORDER BY level) AS path FROM paths GROUP BY source, slot) x
    ON x.source IS NOT DISTINCT FROM n.source AND x.slot = n.slot
),
folds AS (
  SELECT row_number() OVER () AS r, 1 AS i, shown AS cur, * FROM whole
  UNION ALL SELECT r, i + 1, sha256(concat(path[i].b, cur, path[i].a)), doc_id, leaf, shown, subroot, root, path FROM folds WHERE i <= len(path)
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda p: p.b || p.a), 'string_agg', ''), '')) AS proof_sha256,
  cur AS folded_root, cur = root AS verified
FROM folds WHERE i = coalesce(len(path), 0) + 1
"""


def _sql() -> str:
    head = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars"))
    run = "nodes[3 * i + 1] || coalesce(nodes[3 * i + 2], '') || coalesce(nodes[3 * i + 3], '')"
    up = f"list_transform(generate_series(0, (len(nodes) - 1) // 3), lambda i: sha256({run}))"
    siblings = """array_to_string(nodes[3 * ((pos - 1) // 3) + 1 : pos - 1], '') AS before,
      array_to_string(nodes[pos + 1 : 3 * ((pos - 1) // 3) + 3], '') AS after"""
    return SQL.format(crc=_crc32(), head=head, up=up, siblings=siblings)


def _crc32() -> str:
    """CRC-32 of the decimal id, bit by bit: the engine has no function for it."""
    bit = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    step = "a"
    for _ in range(8):
        step = f"list_transform([{step}], lambda x: {bit})[1]"
    byte = step.replace("[a]", "[xor(a, b)]", 1)
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: CAST(ord(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {byte}), 4294967295)"


@query("op11_merkle_manifest", _sql())
def op11_merkle_manifest(spark, folder):
    """The manifest, and what each leaf folds to where line feeds were deleted from some texts."""
    docs = table(spark, folder, "documents")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    shown = leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), cut])
    found = manifest(docs, presented=shown).withColumn("folded_root", folded(F.col("presented"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
