"""Centroid clustering of whole-number vectors by a VA-file.

Each vector is kept twice: as a few bits per dimension, the cell its component falls into, and in full. A round of
assignment reads the cells alone: tables of the distance from each centroid's component to each cell give, summed over
the dimensions, an interval around the distance to every centroid. Where one interval lies below all others the vector is
assigned without being read. The full vectors are fetched by key for the rest, and for those that move, whose
components leave one centroid's sum and enter another's; the table they are fetched from is bucketed by key, so it is
written once and not shuffled again. All distances are whole numbers, so nothing is rounded.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabulon.errors import InvalidRequest
from tabulon.session import scratch_path
from tabulon.session import computed_once

BITS = 7  # of a cell: seven bits cut a dimension into 128 cells
#: Components beyond this have squared distances over 64 dimensions that a long does not hold.
MAX_COMPONENT = 1 << 27
ROWS_PER_PARTITION = 500_000
_STEP = 4096  # vectors whose bounds are computed at once
_NEW = -1  # not assigned yet
_STATE = "key long, cells binary, cluster int"


def whole_vectors(
    vectors: DataFrame, dimensions: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``vec_id, vector`` (array of int): floor(scale * x) for rows with exactly ``dimensions`` finite components."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    held = vectors.where((F.size(x) == dimensions) & finite)
    return held.select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v)).alias("vector")
    )


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ``seed:vec_id`` has the smallest hash; equal ids by their components, null ids last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select("vector", name.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _spread(whole: DataFrame, dimensions: int) -> tuple[int, dict[str, np.ndarray]]:
    """Rows, and per dimension the least, largest and mean component and its deviation."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dimensions)
                wide = x.astype(np.float64)
                facts = [np.arange(dimensions), np.full(dimensions, len(x)), x.min(0), x.max(0), wide.sum(0), (wide**2).sum(0)]
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in facts], names=["d", "n", "low", "high", "s", "q"])

    parts = whole.select("vector").mapInArrow(measure, "d long, n long, low long, high long, s double, q double")
    found = parts.groupBy("d").agg(*[f(c).alias(c) for c, f in (("n", F.sum), ("low", F.min), ("high", F.max), ("s", F.sum), ("q", F.sum))])
    rows = sorted(found.collect())
    if not rows:
        return 0, {}
    n = rows[0]["n"]
    low, high, s, q = (np.array([r[c] for r in rows]) for c in ("low", "high", "s", "q"))
    return n, {"low": low, "high": high, "mean": s / n, "deviation": np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))}


class Cells:
    """The cells of every dimension, about equally full for normal values, and what they say about distances."""

    def __init__(self, facts: dict[str, np.ndarray], bits: int) -> None:
        quantiles = np.array([NormalDist().inv_cdf(i / (1 << bits)) for i in range(1, 1 << bits)])
        self.cuts = []  # cell j of a dimension holds cuts[j - 1] <= x < cuts[j]
        self.low, self.high = [], []
        for low, high, mean, deviation in zip(facts["low"], facts["high"], facts["mean"], facts["deviation"]):
            cuts = np.unique(np.round(mean + deviation * quantiles).astype(np.int64))
            cuts = cuts[(cuts > low) & (cuts <= high)]
            self.cuts.append(cuts)
            self.low.append(np.concatenate([[low], cuts]))
            self.high.append(np.concatenate([cuts - 1, [high]]))

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, d], "right") for d, c in enumerate(self.cuts)]).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per dimension the least and largest part of the squared distance from each cell (row) to each centroid
        (column), less the squared distance to the centroids' common middle.

        What is taken away is the same for all centroids, so intervals compare as before, but they are much narrower:
        their width grows with a centroid's distance from the middle and not from the vector.
        """
        out = []
        for d in range(centroids.shape[1]):
            middle = int(centroids[:, d].mean())
            at = (centroids[:, d] - middle)[None, :]
            ends = [at * (at - 2 * (end[:, None] - middle)) for end in (self.low[d], self.high[d])]
            out.append((np.minimum(*ends), np.maximum(*ends)))
        return out


def packed(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cell numbers as rows of bytes, ``bits`` of each."""
    each = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits :]
    return np.packbits(each.reshape(len(cells), -1), axis=1)


def unpacked(rows: np.ndarray, dimensions: int, bits: int) -> np.ndarray:
    each = np.unpackbits(rows, axis=1, count=dimensions * bits).reshape(len(rows), dimensions, bits)
    wide = np.zeros((len(rows), dimensions, 8), np.uint8)
    wide[:, :, 8 - bits :] = each
    return np.packbits(wide, axis=2)[:, :, 0]


def bounds(cells: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of cells the interval of the distance to every centroid, less a part common to all."""
    least = np.zeros((len(cells), tables[0][0].shape[1]), np.int64)
    largest = np.zeros_like(least)
    for d, (nearest, furthest) in enumerate(tables):
        least += nearest[cells[:, d]]
        largest += furthest[cells[:, d]]
    return least, largest


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _rows(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.reshape(-1, width)


def assign(centroids: np.ndarray, x: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number where two are as near) and squared distance, of the allowed ones."""
    distance = np.empty((len(x), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        distance[:, c] = ((x - centre) ** 2).sum(1)
    if among is not None:
        distance[~among] = np.iinfo(np.int64).max
    best = distance.argmin(1)
    return best, distance[np.arange(len(x)), best]


class _File:
    """The vectors as a table bucketed by key, which joins by key do not move, and ``state`` (key, cells, cluster)."""

    def __init__(self, whole: DataFrame, dimensions: int, bits: int, n: int, cells: Cells) -> None:
        spark = whole.sparkSession
        self.dimensions, self.bits, self.cells = dimensions, bits, cells
        self.width = -(-dimensions * bits // 8)
        self.name = f"tabulon_vectors_{uuid.uuid4().hex}"
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_PARTITION))
        keyed = whole.withColumn("key", F.monotonically_increasing_id()).repartition(parts, "key")
        keyed.write.option("path", scratch_path(spark, "vectors")).bucketBy(parts, "key").sortBy("key").saveAsTable(self.name)
        self.vectors = spark.table(self.name)

        def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = packed(cells.of(_matrix(batch.column("vector"), dimensions)), bits)
                    unassigned = pa.array(np.full(batch.num_rows, _NEW), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("key"), _binary(rows), unassigned], names=["key", "cells", "cluster"])

        self.state = computed_once(self.vectors.select("key", "vector").mapInArrow(approximate, _STATE))

    def drop(self) -> None:
        self.vectors.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")

    def step(self, centroids: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Assign all vectors; returns how each centroid's sum and count change and, where asked for, how many
        vectors were fetched."""
        dimensions, bits, width, cells, k = self.dimensions, self.bits, self.width, self.cells, len(centroids)

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = cells.tables(centroids)
            for whole_batch in batches:
                for at in range(0, whole_batch.num_rows, _STEP):
                    batch = whole_batch.slice(at, _STEP)
                    least, largest = bounds(unpacked(_rows(batch.column("cells"), width), dimensions, bits), tables)
                    possible = least <= largest.min(1)[:, None]
                    alone = possible.sum(1) == 1
                    to = np.where(alone, possible.argmax(1), _NEW).astype(np.int32)
                    fetch = ~alone | (to != batch.column("cluster").to_numpy())
                    masks = [mask.tobytes() if f else None for mask, f in zip(np.packbits(possible, axis=1), fetch)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c) for c in ("key", "cells", "cluster")] + [pa.array(masks, pa.binary())],
                        names=["key", "cells", "cluster", "possible"],
                    )

        def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                old, to = (batch.column("cluster").to_numpy().copy() for _ in range(2))
                fetched = batch.column("possible").is_valid().to_numpy(zero_copy_only=False)
                vectors = batch.column("vector")
                if fetched.any():
                    which = pa.array(fetched)
                    masks = _rows(batch.column("possible").filter(which), -(-k // 8))
                    x = _matrix(vectors.filter(which), dimensions)
                    to[fetched], _ = assign(centroids, x, np.unpackbits(masks, axis=1, count=k).astype(bool))
                moved = pc.if_else(pa.array(to != old), vectors, pa.scalar(None, vectors.type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("cells"), pa.array(to, pa.int32()), pa.array(old, pa.int32()), pa.array(fetched), moved],
                    names=["key", "cells", "cluster", "old", "fetched", "vector"],
                )

        seen = self.state.mapInArrow(narrow, "key long, cells binary, cluster int, possible binary").alias("s")
        full = self.vectors.select(F.col("key").alias("at"), "vector")
        fetched = seen.join(full, (F.col("key") == F.col("at")) & F.col("possible").isNotNull(), "left").drop("at")
        turn = computed_once(fetched.mapInArrow(resolve, f"{_STATE}, old int, fetched boolean, vector array<int>"))

        def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("vector"), dimensions)
                for which, sign in ((batch.column("old").to_numpy(), -1), (batch.column("cluster").to_numpy(), 1)):
                    known = which != _NEW
                    np.add.at(sums, which[known], sign * x[known])
                    np.add.at(counts, which[known], sign)
            lists = pa.array(list(sums), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(counts), lists], names=["c", "n", "s"])

        # What reaches the driver has k times the dimensions rows, however many vectors there are.
        parts = turn.where("vector is not null").select("cluster", "old", "vector").mapInArrow(changes, "c long, n long, s array<long>")
        each = parts.select("c", "n", F.posexplode("s").alias("d", "s")).groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        sums, counts = np.zeros((k, dimensions), object), np.zeros(k, object)
        for r in each.collect():
            sums[r["c"], r["d"]], counts[r["c"]] = r["s"], r["n"]
        self.state = turn.select("key", "cells", "cluster")
        return sums, counts, turn.where("fetched").count() if counted else 0

def cluster_vectors(
    vectors: DataFrame, clusters: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2,
    bits: int = BITS, vec_id: str = "vec_id", vector: str = "embedding", report: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """Clusters of all vectors with exactly ``dimensions`` finite components; the others have no row.

    Columns: ``vec_id``, ``cluster``, ``distance`` (squared, to its centroid), ``cluster_inertia`` and ``inertia`` (distances
    summed over the cluster and over all), ``centroid_sha256`` (hash of the centroid's components joined by commas).
    Components become floor(scale * x). The first centroids are the vectors with the smallest hash of ``seed:vec_id``; each
    round assigns all vectors and moves each centroid to the floor of the mean, a centroid without vectors stays.
    Of two equally near centroids the smaller number wins. Null and repeated ids are rows like others; fewer vectors than
    clusters make that many clusters; an empty table has no rows; other columns are not looked at. A component beyond
    ``MAX_COMPONENT`` is an error, since its distances do not fit the result. ``report(round, fetched)`` hears how many
    full vectors a round fetched. On the driver: the centroids, their sums, and facts of each dimension.
    """
    if not 1 <= bits <= 8:
        raise InvalidRequest("a cell takes 1 to 8 bits")
    whole = whole_vectors(vectors, dimensions, scale, vec_id, vector)
    n, facts = _spread(whole, dimensions)
    result = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kind = whole.schema["vec_id"].dataType
    if not n:
        return vectors.sparkSession.createDataFrame([], result.format(kind.simpleString()))
    if max(facts["high"].max(), -facts["low"].min()) > MAX_COMPONENT:
        raise InvalidRequest(f"components beyond {MAX_COMPONENT} after scaling")
    whole = whole.select("vec_id", F.col("vector").cast("array<int>").alias("vector"))
    centroids = first_centroids(whole, clusters, seed)
    k = len(centroids)
    file = _File(whole, dimensions, bits, n, Cells(facts, bits))
    sums, counts = np.zeros((k, dimensions), object), np.zeros(k, object)
    for turn in range(rounds + 1):
        more, change, fetched = file.step(centroids, report is not None)
        if report is not None:
            report(turn, fetched)
        sums, counts = sums + more, counts + change
        if turn == rounds:
            break
        moved = np.array([[int(s) // int(m) for s in row] if m else list(old) for row, m, old in zip(sums, counts, centroids)], np.int64)
        if (moved == centroids).all():
            break  # later rounds would find the same
        centroids = moved

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column("vector"), dimensions), batch.column("cluster").to_numpy()
            far = ((x - centroids[at]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    placed = file.state.select("key", "cluster").join(file.vectors, "key").select("vec_id", "cluster", "vector")
    placed = computed_once(placed.mapInArrow(measure, f"vec_id {kind.simpleString()}, cluster int, distance long"))
    file.drop()
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    facts_of = F.create_map(*[x for c, s in sorted(inertia.items()) for x in (F.lit(c), F.struct(F.lit(s).cast("long").alias("s"), F.lit(hashes[c]).alias("h")))])
    return placed.select(
        "vec_id", "cluster", "distance", facts_of[F.col("cluster")]["s"].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), facts_of[F.col("cluster")]["h"].alias("centroid_sha256"),
    )
