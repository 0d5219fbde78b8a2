"""Benchmark decontamination: one Aho-Corasick automaton over all test items, each text scanned once."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.rows import over_texts, with_result
from tabulon.session import computed_once

WINDOW = 10
# Bounds of one automaton: bytes of its items, which are sent to every task, and nodes, of about 46 bytes each in a worker.
MAX_ITEM_BYTES = 64 << 20
MAX_NODES = 6_000_000
PIECE_WORDS = 10_000  # words from which on a long item is cut into pieces

# A-Z become a-z; other ASCII outside 0-9 and a-z separates words; bytes of longer code points belong to words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def words_of(text: str | None) -> list[bytes]:
    return [w for w in normalised(text or "") if w]


class Windows:
    """An Aho-Corasick automaton over the windows of test items.

    Words are numbered and written as two symbols, one from each of two ranges, so that a match can only begin with
    a word, no node has many children, and a window takes at most 2 nodes a word (about 46 bytes each).
    """

    def __init__(self, pieces: list[tuple[str | None, str]], window: int) -> None:
        """``pieces`` are (item, normalised words with a blank between them), each with all its windows."""
        self.items = sorted({i for i, _ in pieces}, key=lambda i: (i is None, i))
        place = {item: k for k, item in enumerate(self.items)}
        split = [(place[item], line.encode("utf-8", "surrogatepass").split()) for item, line in pieces]
        self.numbers: dict[bytes, int] = {}
        for _, words in split:
            for word in words:
                self.numbers.setdefault(word, len(self.numbers) + 1)
        self.base = math.isqrt(len(self.numbers) + 1) + 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        sizes, held = [], []
        for item, words in split:
            size, line = min(window, len(words)), self.symbols(words)
            for i in range(len(words) - size + 1 if words else 0):
                key = line[2 * i : 2 * (i + size)]
                number = self.automaton.get(key, len(sizes))
                if number == len(sizes):
                    self.automaton.add_word(key, number)
                    sizes.append(size)
                held.append((number, item))
        self.sizes = np.array(sizes, np.int64)
        pairs = np.unique(np.array(held, np.int64).reshape(-1, 2), axis=0)
        self.holders, self.edges = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(sizes) + 1))
        self.automaton.make_automaton()

    def symbols(self, words: list[bytes]) -> str:
        """Two symbols a word; words that no item has get a symbol that no window has."""
        number = self.numbers.get
        numbers = np.fromiter((number(w, 0) for w in words), np.uint32, len(words))
        line = np.empty((len(words), 2), np.uint32)
        line[:, 0], line[:, 1] = numbers // self.base, numbers % self.base + self.base + 1
        line[numbers == 0] = 2 * self.base + 2
        return line.tobytes().decode("utf-32-le", "surrogatepass")

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str | None]]:
        """Stretches of hit words (first, end) and the items whose windows occur."""
        hits = list(self.automaton.iter(self.symbols(words))) if len(self.sizes) and words else []
        if not hits:
            return [], []
        ends, numbers = np.array(hits, np.int64).T
        stop = (ends + 1) // 2
        which = np.unique(np.concatenate([self.holders[self.edges[n] : self.edges[n + 1]] for n in np.unique(numbers)]))
        return merged(zip((stop - self.sizes[numbers]).tolist(), stop.tolist())), [self.items[k] for k in which.tolist()]


def merged(stretches: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that meet or overlap put together, in order."""
    found: list[tuple[int, int]] = []
    for first, end in sorted(stretches):
        if found and first <= found[-1][1]:
            found[-1] = found[-1][0], max(end, found[-1][1])
        else:
            found.append((first, end))
    return found


def _offsets(text: str) -> list[tuple[int, int]]:
    """Code-point spans of the words in the original text."""
    spans, start = [], -1
    for i, c in enumerate(text):
        inside = ord(c) >= 0x80 or c.isalnum()
        if inside and start < 0:
            start = i
        elif not inside and start >= 0:
            spans.append((start, i))
            start = -1
    return spans + [(start, len(text))] if start >= 0 else spans


def _pieces(items: DataFrame, window: int, piece_words: int) -> DataFrame:
    """``item, line, nodes``: normalised words of each item; long items in pieces that together have all its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                words = words_of(text)
                for first in range(0, max(len(words) - window + 1, 1) if words else 0, piece_words):
                    part = words[first : first + piece_words + window - 1]
                    size = min(window, len(part))
                    found.append((item, b" ".join(part).decode("utf-8", "surrogatepass"), 2 * size * (len(part) - size + 1)))
            if found:
                kinds = [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["item", "line", "nodes"])

    return items.mapInArrow(run, "item string, line string, nodes long").distinct()


def _parts(pieces: DataFrame, most_nodes: int, most_bytes: int) -> DataFrame:
    """Pieces dealt out by hash to as few parts (a power of two) as keep each below both bounds, or of one piece."""
    size = F.octet_length("line") + 16
    load = [F.count(F.lit(1)).alias("pieces"), F.sum("nodes").alias("nodes"), F.sum(size).alias("bytes")]
    number = 1
    while True:
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item", "line"), F.lit(number)).cast("int"))
        above = (F.col("pieces") > 1) & ((F.col("nodes") > most_nodes) | (F.col("bytes") > most_bytes))
        if dealt.groupBy("part").agg(*load).where(above).isEmpty():
            return dealt
        number *= 2


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_RESULTS = "n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<start: long, end: long>>"


def _described(batch: pa.RecordBatch, found: list[tuple[str | None, int, list[tuple[int, int]], list[str | None]]]) -> pa.RecordBatch:
    """The result columns, from each text with its number of words, its stretches of hit words and its items."""
    spans = []
    for text, _, stretches, _ in found:
        places = _offsets(text) if stretches else []
        spans.append([{"start": places[a][0], "end": places[b - 1][1]} for a, b in stretches])
    arrays = [
        pa.array([n for _, n, _, _ in found], pa.int64()),
        pa.array([sum(b - a for a, b in stretches) for _, _, stretches, _ in found], pa.int64()),
        pa.array([len(items) for _, _, _, items in found], pa.int64()),
        pa.array([sorted(i for i in items if i is not None) for _, _, _, items in found], pa.list_(pa.string())),
        pa.array(spans, pa.list_(_SPAN)),
    ]
    return with_result(batch, arrays, ["n_words", "n_hit", "n_items", "item_ids", "spans"])


def _by_parts(docs: DataFrame, dealt: DataFrame, parts: list[int], window: int, doc_id: str, text: str, whole_rows: bool) -> DataFrame:
    """One pass over the texts for each part, one after the other; what different texts hit is kept and merged."""
    spark = docs.sparkSession
    digest = F.sha2(F.col(f"`{text}`"), 256)
    hits = None
    for part in parts:
        one = spark.sparkContext.broadcast([(r["item"], r["line"]) for r in dealt.where(F.col("part") == part).select("item", "line").collect()])

        def run(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            windows = Windows(one.value, window)
            for batch in batches:
                found = [(key, *windows.scan(words_of(t))) for key, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist())]
                found = [x for x in found if x[1]]
                stretches = pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in found], pa.list_(_SPAN))
                arrays = [pa.array([x[0] for x in found], pa.string()), stretches, pa.array([x[2] for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "hit", "items"])

        source = docs.select(digest.alias("key"), F.col(f"`{text}`").alias("t"))
        kept = computed_once(source.mapInArrow(run, "key string, hit array<struct<start: long, end: long>>, items array<string>").dropDuplicates(["key"]))
        one.destroy()
        hits = kept if hits is None else hits.unionAll(kept)
    together = hits.groupBy("key").agg(F.flatten(F.collect_list("hit")).alias("hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    columns = [F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"), digest.alias("key")]
    if whole_rows:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = docs.select(*columns).join(together, "key", "left").drop("key")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("t", "hit", "items")))
            yield _described(batch, [(t, len(words_of(t)), merged((x["start"], x["end"]) for x in hit or []), items or []) for t, hit, items in rows])

    kinds = met.schema
    shape = ", ".join(f"{name} {kinds[c].dataType.simpleString()}" for c, name in (("d", "doc_id"), ("row", "row")) if c in met.columns)
    return met.mapInArrow(finish, f"{shape}, {_RESULTS}")


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", max_item_bytes: int = MAX_ITEM_BYTES, max_nodes: int = MAX_NODES, whole_rows: bool = False,
) -> DataFrame:
    """Words of each document that stand inside an occurrence of a window of a test item.

    One row per input row: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``item_ids`` (sorted as strings) and
    ``spans`` (start and end of each hit stretch in the original text, in code points, end exclusive); with ``whole_rows``
    also ``row``, all columns of the input. Words are runs
    of ASCII letters, digits and all other non-ASCII code points, A-Z lower-cased. A window is ``window`` consecutive
    words of an item; an item with fewer words is one window, one without words has none. Null or empty texts have
    no words; repeated rows are scanned each; no items: nothing is hit. Items without id hit like others; together they
    count as one item, which ``item_ids`` does not list. Other columns are not looked at.
    The windows are one automaton as long as it has at most ``max_nodes`` nodes and its items ``max_item_bytes`` bytes:
    both are measured, since the items are sent to every task and the automaton is built there. Beyond that the items are
    dealt to parts, long ones in pieces, each part is an automaton of its own that scans all texts, and the hits of all
    parts are merged. So a worker never holds more than one part, whatever the items.
    """
    chosen = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).where(F.col("t").isNotNull())
    pieces = computed_once(_pieces(chosen, window, max(1, min(PIECE_WORDS, max_nodes // (2 * window)))))
    dealt = _parts(pieces, max_nodes, max_item_bytes)
    parts = [r["part"] for r in dealt.select("part").distinct().orderBy("part").collect()]
    if len(parts) > 1:
        return _by_parts(docs, dealt, parts, window, doc_id, text, whole_rows)
    wanted = docs.sparkSession.sparkContext.broadcast([(r["item"], r["line"]) for r in pieces.select("item", "line").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(wanted.value, window)
        for batch in batches:
            split = ((t, words_of(t)) for t in batch.column("t").to_pylist())
            yield _described(batch, [(t, len(words), *windows.scan(words)) for t, words in split])

    return over_texts(docs, run, _RESULTS, doc_id, text, whole_rows)
