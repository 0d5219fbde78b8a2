"""Removal of repeated word windows by recompression.

Words are named by hashes of their content, and so is everything built of them: a run of equal symbols becomes one
symbol, then neighbours are paired where a bit of the left name and a bit of the right name say so. A name depends on
content alone, so all tasks name equal things equally and a round of naming needs no shuffle. Whether two neighbours
are paired depends on them only; therefore equal stretches are cut alike except near their ends.

Spark rounds then work from long symbols to short ones:

1. Symbols after many rounds, dozens of words long, and pairs of such neighbours: where one also occurs in an earlier
   document, all windows inside it are repeats. This settles the inside of long repeats.
2. Each window left names one short block inside it, chosen by content, together with the stretch of words that
   determines the block's ends. Equal windows choose equal blocks; a block no other document has rules its windows out.
3. Windows left after that are compared by their own hashes with all earlier documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.arrays import SPACE, between, flat, mix, run_hashes, running, signed, slices, spans, word_hashes
from tabulon.llm.streams import ROWS, among, ask_earlier, ask_shared, told_earlier, told_keys, told_shared

WINDOW = 13
ROUNDS = 14  # a round makes three symbols of four; after two, blocks are cut by what a window holds
_LAST = (1 << 63) - 1


class Words:
    """The words of a slice of texts, named, with the symbols of each round."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        data, offsets = flat(texts)
        starts, ends, self.doc = spans(data, offsets, SPACE)
        self.names = word_hashes(data, starts, ends)
        self.sums, self.down = running(mix(self.names))
        edges = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.begin, self.end = edges[:-1][self.doc], edges[1:][self.doc]  # of each word's document
        n = max(0, len(self.doc) - window + 1)
        self.windows = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :][:n])
        self.window = window

    def window_hashes(self) -> np.ndarray:
        return run_hashes(self.names, self.window)[self.windows] if len(self.windows) else np.zeros(0, np.uint64)

    def content(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return between(self.sums, self.down, starts, ends)

    def runs(self, at: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal neighbours of one document become one symbol."""
        keep = np.ones(len(at), bool)
        keep[1:] = (shape[1:] != shape[:-1]) | (self.doc[at[1:]] != self.doc[at[:-1]])
        return at[keep], shape[keep]

    def pairs(self, at: np.ndarray, shape: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """A left symbol and a right one after it become one; a bit of the name says which a symbol is."""
        left = (mix(shape + np.uint64(turn)) & np.uint64(1)).astype(bool)
        joined = np.zeros(len(at), bool)
        joined[:-1] = left[:-1] & ~left[1:] & (self.doc[at[1:]] == self.doc[at[:-1]])
        shape = shape.copy()
        both = np.flatnonzero(joined)
        shape[both] = mix(shape[both] * np.uint64(3) + mix(shape[both + 1]) + np.uint64(turn))
        keep = np.ones(len(at), bool)
        keep[1:] = ~joined[:-1]
        return at[keep], shape[keep]

    def ends(self, at: np.ndarray) -> np.ndarray:
        """Where each symbol ends: at the next one, or with its document."""
        return np.append(at[1:], len(self.doc)) if len(at) else at

    def first_rounds(self) -> list[tuple[np.ndarray, np.ndarray]]:
        at = self.runs(np.arange(len(self.names)), self.names)
        one = self.pairs(*at, 1)
        return [one, self.pairs(*one, 2)]

    def long_symbols(self, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the last round's symbols and of neighbouring pairs, where a window fits in."""
        at, shape = self.first_rounds()[-1]
        for turn in range(3, rounds + 1):
            at, shape = self.pairs(*self.runs(at, shape), turn)
        ends = self.ends(at)
        next_ = self.doc[at[1:]] == self.doc[at[:-1]]
        starts, ends = np.concatenate([at, at[:-1][next_]]), np.concatenate([ends, ends[1:][next_]])
        fits = ends - starts >= self.window
        return starts[fits], ends[fits]

    def owners(self) -> np.ndarray:
        """A name for each window that equal windows share: of the block inside it with the smallest name, else its own.

        A block [p, q) of the second round is cut at p because of the symbols of the first round on either side, and those
        because of one word beyond them. With all these words inside a window, each equal window holds that block.
        """
        (one, _), (two, _) = self.first_rounds()
        own = mix(self.window_hashes() + np.uint64(7))
        if not len(two):
            return own
        one_ends = self.ends(one)
        first, until = np.searchsorted(one, two), self.ends(two)
        after = np.searchsorted(one, until)
        known = (first > 0) & (after < len(one))
        first, after, p, q = first[known], after[known], two[known], until[known]
        low, high = one[first - 1] - 1, one_ends[after] + 1
        inside = (low >= self.begin[p]) & (high <= self.end[p])
        low, high, p, q = low[inside], high[inside], p[inside], q[inside]
        names = mix(self.content(low, high) + (p - low).astype(np.uint64) * np.uint64(5) + (q - low).astype(np.uint64) * np.uint64(77))
        least, most = np.searchsorted(low, self.windows), np.searchsorted(high, self.windows + self.window, "right")
        best = np.full(len(self.windows), np.iinfo(np.uint64).max)
        for j in range(int((most - least).max(initial=0))):
            here = np.flatnonzero(least + j < most)
            best[here] = np.minimum(best[here], names[least[here] + j])
        return np.where(most > least, best, own)

    def covered(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words stand in one of the stretches."""
        change = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, ends, -1)
        return np.cumsum(change)[:-1] > 0

    def settled(self, told: pa.Array, rounds: int) -> np.ndarray:
        """Which windows lie inside a long symbol that an earlier document has."""
        starts, ends = self.long_symbols(rounds)
        hit = among(self.content(starts, ends), self.doc[starts], *told_keys(told))
        inside = np.zeros(len(self.doc), bool)
        if hit.any():
            inside = self.covered(starts[hit], ends[hit] - self.window + 1)
        return inside[self.windows]


def _in_batch(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without what stands twice in a row."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], owner[new]


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each document without the words of windows that an earlier document has.

    Columns ``doc_id, n_words, n_removed, kept`` (the words left, joined by one blank) of every row. Words are runs
    without ASCII white space. A window is ``window`` consecutive words of one document; each word in a window whose
    words also stand one after the other in a document with a smaller id is removed. Windows are judged on the input.
    Null or empty texts have no words; rows with one id are one owner, so they do not remove from each other; null ids
    come last, as one owner; other columns are not looked at; an empty table gives no rows. Words and windows are
    compared by 64-bit hashes.

    Texts are dealt once by id; the four passes over them read the same shuffled rows. What travels besides are names:
    long symbols, one block for about four windows, and windows that may be repeats. Rows of a name are sorted
    and read as a stream, so a passage that every document has needs no more memory than any other.
    """
    given = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("owner"),
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )

    def asking(emit, ask):
        """A pass over the texts; what each batch emits is settled there as far as possible."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for part in slices(iter([batch]), "text"):
                    words = Words(part.column("text"), window)
                    key, row = emit(words, part)
                    found.append(_in_batch(key, part.column("owner").to_numpy()[row]))
                if found:
                    yield ask(*(np.concatenate(x) for x in zip(*found)))

        return run

    def long_names(words: Words, part: pa.RecordBatch):
        starts, ends = words.long_symbols(rounds)
        return words.content(starts, ends), words.doc[starts]

    def block_names(words: Words, part: pa.RecordBatch):
        left = ~words.settled(part.column("long"), rounds)
        return words.owners()[left], words.doc[words.windows[left]]

    def window_names(words: Words, part: pa.RecordBatch):
        row = words.doc[words.windows]
        left = among(words.owners(), row, *told_keys(part.column("blocks"))) & ~words.settled(part.column("long"), rounds)
        return words.window_hashes()[left], row[left]

    def shared_with(key: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        return ask_shared(key, owner, owner, np.zeros(len(key), np.int32))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"), window)
            gone = words.settled(part.column("long"), rounds)
            gone |= among(words.window_hashes(), words.doc[words.windows], *told_keys(part.column("windows")))
            at = words.windows[gone]
            removed = words.covered(at, at + window)
            edges = np.searchsorted(words.doc, np.arange(len(part) + 1))
            lost = np.concatenate([[0], np.cumsum(removed)])
            lost = lost[edges[1:]] - lost[edges[:-1]]
            left = []
            for i, text in enumerate(part.column("text").to_pylist()):
                each = text.encode("utf-8", "surrogatepass").split()
                left.append(b" ".join(compress(each, ~removed[edges[i] : edges[i + 1]]) if lost[i] else each).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(edges)), pa.array(lost), pa.array(left, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    def by_owner(told: DataFrame, name: str) -> DataFrame:
        """The keys told to each owner: as many as it asked about at most."""
        return told.groupBy("owner").agg(F.collect_list("key").alias(name))

    long = by_owner(told_earlier(given.select("owner", "text").mapInArrow(asking(long_names, ask_earlier), ROWS)), "long")
    with_long = given.join(long, "owner", "left")
    blocks = by_owner(told_shared(with_long.mapInArrow(asking(block_names, shared_with), ROWS)), "blocks")
    with_blocks = with_long.join(blocks, "owner", "left")
    windows = by_owner(told_earlier(with_blocks.mapInArrow(asking(window_names, ask_earlier), ROWS)), "windows")
    kind = given.schema["doc_id"].dataType.simpleString()
    return with_long.join(windows, "owner", "left").mapInArrow(kept, f"doc_id {kind}, n_words long, n_removed long, kept string")
