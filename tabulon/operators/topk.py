"""The best hits of many queries: each task keeps its own best, one window merges them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Cells of a score matrix that are computed at once.
SCORES_PER_STEP = 2_000_000


class BestHits:
    """The ``k`` best rows per query among the batches seen so far, ties by id."""

    def __init__(self, k: int, queries: int) -> None:
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.hits: pa.Table | None = None

    def add(self, scores: np.ndarray, possible: np.ndarray, ids: pa.Array) -> None:
        """Take in a (rows x queries) score matrix; ``possible`` marks scores that may win; NaN never does."""
        possible = possible & ~np.isnan(scores)
        masked = np.where(possible, scores, -np.inf)
        if len(masked) >= self.k:
            kth = np.partition(masked, len(masked) - self.k, axis=0)[len(masked) - self.k]
            self.floor = np.maximum(self.floor, kth)
        row, query = np.nonzero(possible & (masked >= self.floor))
        found = pa.table(
            {"query": pa.array(query), "id": ids.take(pa.array(row)), "score": pa.array(scores[row, query])}
        )
        self.hits = found if self.hits is None else pa.concat_tables([self.hits, found])
        if self.hits.num_rows > 4 * self.k * len(self.floor):
            self.hits = self._best()

    def _best(self) -> pa.Table:
        order = [("query", "ascending"), ("score", "descending"), ("id", "ascending")]
        ranked = self.hits.combine_chunks().sort_by(order)
        query = ranked["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        return ranked.filter(pa.array(place < self.k))

    def batches(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.hits is None:
            return
        best = self._best()
        named = query_ids.take(best["query"].combine_chunks())
        yield from pa.table({"query_id": named, "id": best["id"], "score": best["score"]}).to_batches()


def merge_hits(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the best hits of each query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
