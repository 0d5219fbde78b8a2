"""Text vectors, cosine search and rank fusion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabulon.errors import InvalidRequest
from tabulon.functions.rounding import half_up
from tabulon.functions.schema import col, require_columns
from tabulon.functions.text import tokens
from tabulon.operators.lexical import bm25
from tabulon.operators.topk import SCORES_PER_STEP, BestHits, merge_hits
from tabulon.session import computed_once, scratch_path

# Digits of ranking and score, fusion constants, the candidate rule.
RANK_DIGITS, SCORE_DIGITS = 9, 4
FUSION_CONSTANT, VECTOR_SHARE = 60, 0.65
CANDIDATES_PER_HIT, MIN_CANDIDATES = 4, 20
HASH_DIMENSIONS = 64
#: Cells at most (their pivots are sent to every task), cells a query visits at first, and times as many in each further round.
MAX_CELLS, FIRST_CELLS, MORE_CELLS = 4096, 8, 8
VECTORS_PER_CELL = 1_000  # a smaller table has fewer cells
#: Vectors of one cell, and queries that visit it, that come to one task.
VECTORS_PER_TASK, QUERIES_PER_TASK = 200_000, 20_000
ZERO = -1  # the cell of zero vectors
SLACK = 10.0 ** (1 - RANK_DIGITS)  # more than rounding moves a score


def hash_vectors(codes: pa.ListArray, dimensions: int = HASH_DIMENSIONS) -> np.ndarray:
    """A signed count of word hashes per text, given the CRC-32 of its words: the same words always give the same vector."""
    out = np.zeros((len(codes), dimensions), dtype=np.float32)
    code = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.list_parent_indices(codes).to_numpy()
    np.add.at(out, (row, code % dimensions), np.where(code & 0x80000000, 1.0, -1.0).astype(np.float32))
    return out


def embed(
    df: DataFrame,
    text_column: str,
    encode: Callable[[list[str]], Sequence[Sequence[float]]] | None = None,
    name: str = "embedding",
    batch: int = 256,
) -> DataFrame:
    """Add a vector per text. ``encode`` maps a list of texts to vectors, for instance a model
    the caller loads; without it words are hashed."""
    require_columns(df, [text_column])

    @F.pandas_udf("array<float>")
    def by_caller(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            vectors: list = []
            for at in range(0, len(texts), batch):
                vectors.extend(np.asarray(encode(texts[at : at + batch]), dtype=np.float32))
            yield pd.Series(vectors)

    @F.arrow_udf("array<float>")
    def by_words(codes: pa.Array) -> pa.Array:
        made = hash_vectors(codes)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * HASH_DIMENSIONS, pa.int32()), pa.array(made.ravel(), pa.float32()))

    made = by_words(F.transform(tokens(col(text_column)), F.crc32)) if encode is None else by_caller(col(text_column))
    return df.withColumn(name, made)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _bounds(asked: np.ndarray, pivots: np.ndarray, radius: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """The largest cosine that each query (row) can have with a vector of each cell."""
    unit = _unit(asked)
    best = np.cos(np.maximum(_angles(unit @ pivots.T) - radius, 0.0))
    best[:, zero] = 0.0
    best[~unit.any(1)] = 0.0
    return best


class _Cells:
    """Vectors dealt to cells around pivots, and how wide and how full each cell is. Zero vectors have a cell of their own."""

    def __init__(self, held: DataFrame, width: int) -> None:
        self.width, self.pivots = width, np.zeros((1, width))
        n = held.count()
        most = min(MAX_CELLS, math.isqrt(n), -(-n // VECTORS_PER_CELL))
        if most:
            # A bounded sample: the vectors with the smallest hashes.
            rows = held.select("vector").orderBy(F.xxhash64("id", "vector"), "vector").limit(most).collect()
            self.pivots = np.unique(_unit(np.array([r["vector"] for r in rows], dtype=np.float64)), axis=0)
        pivots = self.pivots

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _unit(_matrix(batch.column("vector"), width))
                    cosines = near @ pivots.T
                    cell = cosines.argmax(1)
                    angle = _angles(cosines[np.arange(len(cell)), cell])
                    cell = np.where(near.any(1), cell, ZERO)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int32()), pa.array(angle), batch.column("id"), batch.column("vector")], names=["cell", "angle", "id", "vector"]
                    )

        path = scratch_path(held.sparkSession, "cells")
        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), *held.schema.fields])
        held.mapInArrow(deal, schema).write.parquet(path)
        self.vectors = held.sparkSession.read.schema(schema).parquet(path)
        facts = self.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).orderBy("cell").collect()
        self.numbers = np.array([r["cell"] for r in facts], dtype=np.int64)
        self.sizes = [r["n"] for r in facts]
        self.radius = np.array([r["radius"] for r in facts], dtype=np.float64)

    def visits(self, asked: DataFrame) -> DataFrame:
        """(q, cell, bound, nth): the cells in the order in which a query visits them."""
        numbers, pivots, radius, width = self.numbers, self.pivots[np.maximum(self.numbers, 0)], self.radius, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(numbers):
                    best = _bounds(_matrix(batch.column("vector"), width), pivots, radius, numbers == ZERO)
                    order = np.argsort(-best, axis=1, kind="stable")
                    q = np.repeat(batch.column("q").to_numpy(), len(numbers))
                    nth = np.tile(np.arange(1, len(numbers) + 1), batch.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q), pa.array(numbers[order].ravel(), pa.int32()), pa.array(np.take_along_axis(best, order, 1).ravel()), pa.array(nth, pa.int32())],
                        names=["q", "cell", "bound", "nth"],
                    )

        return asked.select("q", "vector").mapInArrow(run, "q long, cell int, bound double, nth int")

    def visited(self, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """(q, id, score): the best hits of some queries in some cells. Pairs: ``q``, ``cell`` and ``floor`` (null where unknown).

        A cell's vectors and the queries that visit it come together; a full cell is dealt to several tasks, to each
        of which its queries are sent, and where very many queries visit a cell its vectors are sent to each share of them.
        """
        spark, width = pairs.sparkSession, self.width
        facts = [(int(c), -(-n // VECTORS_PER_TASK)) for c, n in zip(self.numbers, self.sizes)]
        # One row per cell.
        salts = F.broadcast(spark.createDataFrame(facts, "cell int, salts int"))
        shares = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES_PER_TASK)).cast("int").alias("shares"))
        counted = F.broadcast(shares.join(salts, "cell"))
        empty = F.lit(None)
        queries = pairs.join(counted, "cell").join(asked.select("q", "vector"), "q").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("q"), F.col("shares")).cast("int").alias("share"),
            F.lit(0).alias("kind"), "q", "floor", empty.cast(self.vectors.schema["id"].dataType).alias("id"), "vector",
        )
        vectors = self.vectors.join(counted, "cell").select(
            "cell", F.pmod(F.xxhash64("id", "vector"), F.col("salts")).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
            F.lit(1).alias("kind"), empty.cast("long").alias("q"), empty.cast("double").alias("floor"), "id", "vector",
        )
        key = ["cell", "salt", "share"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, names, floors, waiting, best, unit = None, [], [], [], None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.column_stack([batch.column(c).to_numpy() for c in (*key, "kind")])
                cuts = np.append(np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])), len(keys))
                for a, b in zip(cuts, cuts[1:]):
                    part, here = batch.slice(a, b - a), tuple(keys[a][:3])
                    if here != at:
                        if best is not None:
                            yield from best.batches(pa.array(names, pa.int64()))
                        at, names, floors, waiting, best = here, [], [], [], None
                    matrix = _matrix(part.column("vector"), width)
                    if not keys[a][3]:
                        names += part.column("q").to_pylist()
                        floors.append(part.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False))
                        waiting.append(matrix)
                        continue
                    if not names:
                        continue
                    if best is None:
                        best, unit = BestHits(k, len(names)), _unit(np.concatenate(waiting)).T
                        best.floor = np.concatenate(floors) - SLACK
                    step = max(1, SCORES_PER_STEP // len(names))
                    for i in range(0, len(matrix), step):
                        near = np.round(_unit(matrix[i : i + step]) @ unit, RANK_DIGITS)
                        best.add(near, np.ones_like(near, dtype=bool), part.column("id").slice(i, step))
            if best is not None:
                yield from best.batches(pa.array(names, pa.int64()))

        schema = T.StructType([T.StructField("query_id", T.LongType()), self.vectors.schema["id"], T.StructField("score", T.DoubleType())])
        dealt = queries.unionByName(vectors).repartition(*key).sortWithinPartitions(*key, "kind")
        return computed_once(dealt.mapInArrow(run, schema).withColumnRenamed("query_id", "q"))


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str,
    vector_column: str,
    query_id: str,
    query_vector: str,
    k: int = 8,
    report: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest vectors of every query by cosine, exactly.

    Vectors are dealt to cells around pivots. From the angle between a query and a pivot, less the cell's widest angle,
    follows the best cosine the cell may hold. A query visits its most promising cells first; in further rounds only
    those that may still hold one of its ``k`` best, ties included. Queries are joined to cells and never pass the driver.
    Scores below zero show as zero. Rows without a vector, with one of another length or with null, NaN or an infinite
    number in it are never hits. ``report`` hears how many (query, cell) pairs there are and how many were visited.
    """
    require_columns(vectors, [id_column, vector_column])
    require_columns(queries, [query_id, query_vector])
    spark = vectors.sparkSession

    def whole(name: str) -> Column:
        x = col(name).cast("array<double>")
        return F.when(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), x)

    given = queries.select(col(query_id).alias("query_id"), col(query_vector).cast("array<double>").alias("given"))
    asked = computed_once(given.where("given is not null").withColumn("vector", whole("given")).withColumn("q", F.monotonically_increasing_id()))
    widths = asked.agg(F.min(F.size("given")).alias("least"), F.max(F.size("given")).alias("most")).first()
    kind = vectors.schema[id_column].dataType
    if not widths["most"]:
        schema = T.StructType([asked.schema["query_id"], T.StructField("id", kind), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return spark.createDataFrame([], schema)
    if widths["least"] != widths["most"]:
        raise InvalidRequest("the query vectors differ in length")
    asked = asked.where("vector is not null")
    held = vectors.select(col(id_column).alias("id"), whole(vector_column).alias("vector")).where(F.size("vector") == widths["most"])
    cells = _Cells(held, widths["most"])
    visits = computed_once(cells.visits(asked))
    best, upto = Window.partitionBy("q").orderBy(F.desc("score")), FIRST_CELLS
    left, hits, seen = visits.withColumn("floor", F.lit(None).cast("double")), None, 0
    while hits is None or not left.isEmpty():
        now = left.where(F.col("nth") <= upto)
        seen += now.count() if report is not None else 0
        found = cells.visited(now.select("q", "cell", "floor"), asked, k)
        hits = found if hits is None else hits.unionByName(found)
        floor = hits.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("q", F.col("score").alias("floor"))
        left = left.where(F.col("nth") > upto).drop("floor").join(floor, "q", "left")
        left = computed_once(left.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)))
        upto *= MORE_CELLS
    if report is not None:
        report(visits.count(), seen)
    named = hits.join(asked.select("q", "query_id"), "q").select("query_id", "id", "score")
    return merge_hits(named, k).withColumn("score", half_up(F.greatest("score", F.lit(0.0)), SCORE_DIGITS))


def fuse_ranks(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = 8, alpha: float = VECTOR_SHARE) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists per query."""
    v = vector_hits.select("query_id", "id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    w = keyword_hits.select("query_id", "id", F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score"))
    part_v = F.coalesce(F.lit(alpha) / (FUSION_CONSTANT + F.col("vector_rank")), F.lit(0.0))
    part_w = F.coalesce(F.lit(1 - alpha) / (FUSION_CONSTANT + F.col("keyword_rank")), F.lit(0.0))
    both = v.join(w, ["query_id", "id"], "full").select(
        "query_id", "id", "vector_rank", "keyword_rank",
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"),
        half_up(part_v + part_w, 6).alias("score"),
    )
    return merge_hits(both, k)


def hybrid_search(
    documents: DataFrame,
    queries: DataFrame,
    id_column: str,
    text_column: str,
    vector_column: str,
    query_id: str,
    query_text: str,
    query_vector: str,
    k: int = 8,
    alpha: float = VECTOR_SHARE,
    titles: Sequence[str] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Cosine and BM25 candidates of every query, fused by rank. A document without a vector is
    found by its words alone; to search some documents only, give those."""
    candidates = max(CANDIDATES_PER_HIT * k, MIN_CANDIDATES)
    near = vector_topk(documents, queries, id_column, vector_column, query_id, query_vector, candidates)
    lexical = bm25(documents, queries, id_column, text_column, query_id, query_text, candidates, titles, extra)
    return fuse_ranks(near, lexical, k, alpha)
