"""Document fingerprints by context-triggered piecewise hashing, and their likeness."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 7  # bytes that decide whether a piece ends
SMALLEST_BLOCK = 3
PIECES = 64
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _triggers(data: bytes) -> np.ndarray:
    """A hash of the last ``WINDOW`` bytes at each position, plus one; 0 before the window is full."""
    padded = bytes(7) + data
    last = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    rolled = ((last >> np.uint64(8 * (8 - WINDOW))) * _FACTOR >> np.uint64(34)).astype(np.uint32) + np.uint32(1)
    rolled[: WINDOW - 1] = 1  # no multiple of any block size
    return rolled


def _signature(data: bytes, ends: np.ndarray, most: int) -> str:
    """A letter for each piece; the last one holds all that is left."""
    out, start = [], 0
    for end in [*ends[: most - 1].tolist(), len(data)]:
        if end > start:
            out.append(_LETTERS[zlib.crc32(data[start:end]) & 63])
            start = end
    return "".join(out)


def fingerprint(text: str) -> str:
    """``block:pieces:pieces at twice the block``. A position ends a piece when its hash is a multiple of the block
    size, so every end at twice the size is one at the size too; the size is halved until there are enough pieces."""
    data = text.encode("utf-8", "surrogatepass")
    block = SMALLEST_BLOCK
    while block * PIECES < len(data):
        block *= 2
    rolled = _triggers(data)
    ends = np.flatnonzero(rolled % np.uint32(block) == 0)
    while len(ends) < PIECES // 2 and block > SMALLEST_BLOCK:
        block //= 2
        ends = np.flatnonzero(rolled % np.uint32(block) == 0)
    coarse = ends[rolled[ends] % np.uint32(2 * block) == 0]
    return f"{block}:{_signature(data, ends + 1, PIECES)}:{_signature(data, coarse + 1, PIECES // 2)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; a column of the table is kept in the bits of two numbers."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(diagonal | up) & full, up & diagonal
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        more = (more << 1 | 1) & full
        up, down = (less << 1 | ~(diagonal | more)) & full, more & diagonal
    return distance


def _like(a: str, b: str) -> float:
    return 1 - edit_distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def likeness(a: str, b: str) -> float:
    """0 to 1: the best agreement of two fingerprints at a block size both have; 0 if they share none."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    one = {int(m): a1, 2 * int(m): a2}
    two = {int(n): b1, 2 * int(n): b2}
    return max((_like(one[k], two[k]) for k in one.keys() & two.keys()), default=0.0)


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by the beginning of another, as long as that half at most."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next
    document is the one with the next smaller id, after the last one the first; ids are whole numbers, null the smallest;
    rows with equal ids follow each other by text. Null text is empty, its fingerprint has no pieces; a single row is
    its own next. Other columns are not looked at; an empty table gives no rows.

    Texts move once: they are dealt by ranges of ids and sorted there. Only the first text of a range is needed in the
    range before it as well, and is sent to both. The range bounds are quantiles, one number for each partition.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = source.select(order_id.alias("id"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = np.unique(np.array(ids.approxQuantile("id", steps, 0.1 / ranges) if steps else [], np.float64).astype(np.int64))

    def places(values: pd.Series) -> np.ndarray:
        return np.searchsorted(bounds, values.to_numpy(np.int64), "left")

    @F.pandas_udf("long")
    def own(values: pd.Series) -> pd.Series:
        return pd.Series(places(values))

    heads = [r["id"] for r in ids.withColumn("range", own("id")).groupBy("range").agg(F.max("id").alias("id")).orderBy(F.desc("range")).collect()]
    before = {  # the first id of a range: the range whose last row it follows
        head: int(np.searchsorted(bounds, heads[i - 1], "left")) for i, head in enumerate(heads)
    }

    @F.pandas_udf("array<long>")
    def targets(values: pd.Series) -> pd.Series:
        return pd.Series([[p, before[v]] if v in before else [p] for p, v in zip(places(values), values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (range, id, text, fingerprint) of the row that waits for its next
        for batch in batches:
            done = []
            for place, copy, one, content in zip(*(batch.column(c).to_pylist() for c in ("range", "copy", "doc_id", "text"))):
                if copy and held is None:
                    continue
                print_ = fingerprint(content)
                if held is not None:
                    _, last, before_text, before_print = held
                    changed = edited(before_text, content)
                    changed_print = fingerprint(changed)
                    done.append((
                        last, len(before_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                        before_print, changed_print, likeness(before_print, changed_print), likeness(before_print, print_),
                    ))
                held = None if copy else (place, one, content, print_)
            if done:
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*done), kinds)],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    dealt = (
        source.select("*", F.posexplode(targets(order_id)).alias("copy", "range"))
        .repartition(ranges, "range")
        .sortWithinPartitions(F.desc("range"), "copy", F.desc_nulls_last("doc_id"), "text")
        .select("range", "copy", "doc_id", "text")
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
