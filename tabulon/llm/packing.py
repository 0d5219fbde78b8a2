"""Best-fit packing of token sequences, after a Martello-Toth reduction.

An instance is fully described by how many pieces there are of each length, at most ``capacity`` numbers however many
documents there are. Those counts alone go to the driver; the plan made of them says which ranks of which length go
to which sequences, and every piece looks its place up by its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from tabulon.session import computed_once

CAPACITY = 4096
END_ID = 1
CACHED_PIECES = 200_000
CACHED_CHARS = 100
BATCH_BYTES = 1 << 21


# How the tokenizer splits a word, and the characters for which its normal form is plain lower case.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x7E\xA1-\u012F\u0131-\u024F]*")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it can be printed, else the next free one."""
    printed = {b for b in range(256) if 33 <= b < 127 or b > 160 and b != 173}
    free = iter(range(256, 512))
    return {b: chr(b if b in printed else next(free)) for b in range(256)}


def batch_encoder(tokenizer: Tokenizer) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Ids of whole texts, one text after the other, and where each text begins and the last one ends.

    The tokenizer drops white space and never joins text across it, so the stretches between ASCII white space are
    encoded by themselves, each different one of a batch once. A stretch of Latin letters and marks is split as the
    tokenizer does; its pieces go to the tokenizer's model, and those used last are remembered. Any other stretch goes
    to the tokenizer whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = tokenizer.model
    letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def new_piece(part: str) -> bytes:
        text = part if part.isascii() else part.encode().decode("latin-1").translate(letters)
        return array("I", [token.id for token in model.tokenize(text)]).tobytes()

    known_piece = functools.lru_cache(maxsize=CACHED_PIECES)(new_piece)

    def piece(part: str) -> bytes:
        return (known_piece if len(part) <= CACHED_CHARS else new_piece)(part)

    def stretch(part: str) -> bytes:
        plain = part.isascii() or _PLAIN.fullmatch(part)
        if plain and part.isalpha():
            return piece(part.lower())
        if plain and part[-1:] in ".,:;!?" and part[:-1].isalpha():
            return piece(part[:-1].lower()) + piece(part[-1])
        if "<|" in part or not _PLAIN.fullmatch(part):
            return array("I", tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        return b"".join([piece(x) for x in _SPLIT.findall(part.lower())])

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids = list(map(stretch, coded.dictionary.to_numpy(zero_copy_only=False)))
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(length) - length
        index = coded.indices.to_numpy()
        each = length[index]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
        at = np.repeat(first[index] - ends[:-1], each)
        at += np.arange(len(at))
        offsets = split.offsets.to_numpy()
        return np.frombuffer(b"".join(ids), "<u4")[at], ends[offsets - offsets[0]]

    return encode


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Callable[[str], bytes]:
    """Ids of one whole text as little-endian 32-bit numbers."""
    encode = batch_encoder(Tokenizer.from_file(path))
    return lambda text: encode(pa.array([text], pa.string()))[0].tobytes()


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive rows of about ``BATCH_BYTES`` of text, or one that is longer, and the number of the first of them."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        limit = BATCH_BYTES + (int(ends[at - 1]) if at else 0)
        to = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: whole documents, and cuts of those that are too long."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    # A worker reads a broadcast value once for all its tasks, and keeps the encoder and what it remembers beside it.
    shared = docs.sparkSession.sparkContext.broadcast({"tokenizer": Tokenizer.from_file(tokenizer_path)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "encode" not in held:
            held["encode"] = batch_encoder(held["tokenizer"])
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for before, texts in _parts(batch.column("t").fill_null("")):
                ids, bounds = held["encode"](texts)
                bounds = bounds.tolist()
                for i, (first, last) in enumerate(zip(bounds, bounds[1:]), before):
                    n = last - first + 1  # with the end id
                    for k, at in enumerate(range(0, n, capacity)):
                        here = min(capacity, n - at)
                        value = zlib.crc32(ids[first + at : min(first + at + here, last)])
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(here)
                        crc.append(value if at + here < n else zlib.crc32(end, value))
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    kind = source.schema["d"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """How many pieces of each length are left, and which ranks of them come next."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.taken = np.zeros(capacity + 1, np.int64)
        self._refresh()

    def _refresh(self) -> None:
        sizes = np.arange(len(self.left))
        self.below = np.maximum.accumulate(np.where(self.left > 0, sizes, 0))  # the largest length <= x, or 0
        self.sizes = np.flatnonzero(self.left)

    def take(self, length: int, n: int) -> int:
        first = int(self.taken[length])
        self.taken[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self._refresh()
        return first

    def smallest(self, n: int, apart_from: int) -> int:
        """The sum of the ``n`` smallest pieces besides one of length ``apart_from``; a huge number if there are fewer."""
        total = 0
        for size in self.sizes[: n + 1]:
            here = min(n, int(self.left[size]) - (size == apart_from))
            total, n = total + here * int(size), n - here
            if not n:
                return total
        return 1 << 40

    def largest(self, room: int, apart_from: int) -> int:
        """The largest piece of at most ``room`` besides one of length ``apart_from``; 0 if there is none."""
        size = int(self.below[min(room, len(self.below) - 1)]) if room > 0 else 0
        if size == apart_from and self.left[size] < 2:
            size = int(self.below[size - 1])
        return size

    def best_pair(self, room: int, apart_from: int) -> tuple[int, int]:
        """Two pieces with the largest sum of at most ``room``, the larger first; (0, 0) if there are none."""
        spare = self.left.copy()
        spare[apart_from] -= 1
        sizes = np.flatnonzero(spare[: max(0, room)])
        if not len(sizes):
            return 0, 0
        below = np.maximum.accumulate(np.where(spare > 0, np.arange(len(spare)), 0))
        other = below[np.minimum(room - sizes, sizes)]
        alone = (other == sizes) & (spare[sizes] < 2)
        other = np.where(alone, below[np.maximum(other - 1, 0)], other)
        sums = np.where(other > 0, sizes + other, 0)
        best = int(np.flatnonzero(sums == sums.max())[-1])
        return (int(sizes[best]), int(other[best])) if sums[best] else (0, 0)


def _dominating(stock: _Stock, size: int, capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of ``size`` that is at least as good as any other set with it, where one is proven.

    One set dominates another if the other's pieces can be shared out so that each share fits into the room of one
    piece of the first. Each rule stays true while pieces are taken away, as long as the set itself is in stock.
    """
    room = capacity - size
    second = stock.largest(room, size)
    if not second:
        return (size,)  # nothing fits beside it
    if size + second == capacity:
        return size, second  # whatever shares a sequence with it fits into the room of the second
    if stock.smallest(2, size) > room:
        return size, second  # only one more fits, so the largest
    if stock.smallest(3, size) <= room:
        return None
    a, b = stock.best_pair(room, size)
    if second >= a + b:
        return size, second  # no two pieces fill more than the second alone
    if a == second:
        spare = stock.left.copy()
        spare[size] -= 1
        above = np.flatnonzero(spare[b + 1 :])[:2] + b + 1
        two = 2 * int(above[0]) if len(above) and spare[above[0]] > 1 else int(above.sum()) if len(above) == 2 else 1 << 40
        if two > room:
            return size, a, b  # of any two that fit, the smaller is at most b and the larger at most a
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int, int]:
    """Segments (length, first rank, pieces, first sequence, pieces a sequence, offset), the number of sequences,
    and how many of them the reduction fixed."""
    stock, segments, sequences = _Stock(counts, capacity), [], 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        segments.append((length, stock.take(length, n), n, first, each, offset))

    for size in range(capacity, 0, -1):
        while stock.left[size] and (chosen := _dominating(stock, size, capacity)):
            n = min(int(stock.left[s]) // chosen.count(s) for s in set(chosen))
            offset = 0
            for length in chosen:
                put(length, n, sequences, 1, offset)
                offset += length
            sequences += n
    fixed = sequences
    open_runs: dict[int, list[tuple[int, int]]] = {}  # by room left: first sequence and how many
    has_room = np.zeros(capacity + 1, bool)

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            open_runs.setdefault(room, []).append((first, n))
            has_room[room] = True

    for size in range(capacity, 0, -1):
        n = int(stock.left[size])
        rooms = (np.flatnonzero(has_room[size:]) + size).tolist() if n else []
        for room in [*rooms, capacity]:
            if not n:
                break
            new = room == capacity
            runs = [(sequences, -(-n // (capacity // size)))] if new else open_runs.pop(room)
            has_room[room] = False
            each = room // size
            while runs and n:
                first, many = runs.pop()
                full = min(many, n // each)
                part = min(n - full * each, each - 1) if full < many else 0
                if full:
                    put(size, full * each, first, each, capacity - room)
                    keep(room - each * size, first, full)
                if part:
                    put(size, part, first + full, part, capacity - room)
                    keep(room - part * size, first + full, 1)
                n -= full * each + part
                if new:
                    sequences += full + (part > 0)
                elif many - full - (part > 0):
                    runs.append((first + full + (part > 0), many - full - (part > 0)))
            for first, many in runs:
                keep(room, first, many)
    return np.array(segments, np.int64).reshape(-1, 6), sequences, fixed


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each piece with its ``sequence_id`` and ``offset`` there.

    Columns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null or empty texts are one piece that
    holds the end id alone; repeated rows and repeated ids are packed row by row; other columns are not looked at; an
    empty table gives no rows. A text is encoded whole, in its own task. Pieces are computed once and kept in the
    checkpoint folder; their ranks count the pieces of the same length in earlier partitions, so that no length, not
    even one that most pieces have, meets in one task.
    """
    pieces = computed_once(pieces_of(docs, tokenizer_path, capacity, doc_id, text))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            order = np.argsort(lengths, kind="stable")
            here = lengths[order]
            rank = np.empty(len(here), np.int64)
            rank[order] = np.arange(len(here)) - np.searchsorted(here, here, "left") + seen[here]
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(rank), part, np.int32)), pa.array(rank)],
                names=[*batch.schema.names, "part", "place"],
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    ranks = pieces.mapInArrow(ranked, f"{columns}, part int, place long")
    by_part = pieces.groupBy(F.spark_partition_id().alias("part"), "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, _, _ = plan(counts, capacity)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(segments)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            found = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            within = rank - found[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(found[:, 3] + within // found[:, 4]), pa.array(found[:, 5] + within % found[:, 4] * length)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    whole = ranks.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank")
    )
    return whole.mapInArrow(placed, f"{columns}, sequence_id long, offset long")
