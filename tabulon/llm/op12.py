"""The registered query of centroid clustering."""

from tabulon.llm.base import query, table
from tabulon.llm.clustering import cluster_vectors

CLUSTERS, ROUNDS = 40, 5


def _sql() -> str:
    """The rounds written out; each one assigns the vectors to the centroids and moves these."""
    distance = "list_sum(list_transform(generate_series(1, 64), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = ["""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = 64
)""", f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS INT) AS c, x
  FROM (SELECT sha256('2:' || vec_id) AS h, x FROM kept ORDER BY h NULLS LAST, x LIMIT {CLUSTERS})
)"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, x, best.c AS c, CAST(best.d AS BIGINT) AS d FROM (
    SELECT v.vec_id, any_value(v.x) AS x, min({{'d': CAST({distance} AS BIGINT), 'c': c.c}}) AS best
    FROM (SELECT row_number() OVER () AS r, * FROM kept) v CROSS JOIN c{i} c GROUP BY v.r, v.vec_id)
)""")
        if i < ROUNDS:
            floor = "(s - ((s % n) + n) % n) // n"
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.x, old.x) AS x FROM c{i} old LEFT JOIN (
    SELECT c, list(CAST({floor} AS BIGINT) ORDER BY pos) AS x FROM (
      SELECT c, pos, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY c, pos)
    GROUP BY c) m USING (c)
)""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} f ON f.c = a.c"""


@query("op12_centroid_clustering", _sql())
def op12_centroid_clustering(spark, folder):
    return cluster_vectors(table(spark, folder, "embeddings"), CLUSTERS, ROUNDS, dimensions=64, scale=256, seed=2)
