"""Removal of byte strings that occur twice, by interval expansion on Burrows-Wheeler transforms.

One transform of the whole corpus would be one task. The corpus is therefore cut by content first: every string of
``least`` bytes has an anchor, the position inside it whose next ``ANCHOR`` bytes hash lowest. Equal strings have equal
anchors, so strings with different anchors need not meet. Strings that share an anchor's position are one block.

1. Spark rounds settle whole blocks: one that stands elsewhere too is repeated, one whose anchor no other block has is
   not. What is left are blocks at the ends of repeats.
2. Those meet by anchor, with one copy of each settled block of the anchor. Groups are laid one after the other into
   texts of about 128 KB, and intervals of their suffixes are extended backwards, breadth first. This derives
   common prefixes by increasing length and stops at ``least``: suffixes not yet told apart begin equal strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.arrays import between, flat, mix, running, signed, slices
from tabulon.llm.streams import ROWS, among, ask_shared, told_keys, told_shared

LEAST = 200
ANCHOR = 40
SLICE = 1 << 20
TEXT_BYTES = 1 << 17  # of blocks in one transform, whose tables should stay near the processor
GROUP_BYTES = 4 << 20  # of one anchor; more are cut up and their strings compared across cuts by hash
_LOW = np.uint64(0xFFFFFFFF)


class Blocks:
    """The strings of ``least`` bytes in a slice of texts, as runs of those that share an anchor.

    ``start``, ``count`` (strings), ``doc``, and ``anchor`` and ``name``, hashes of the anchor and of all the block's bytes.
    """

    def __init__(self, texts: pa.Array, least: int, anchor: int) -> None:
        self.data, self.offsets = flat(texts)
        n, none = len(self.data) - least + 1, np.zeros(0, np.int64)
        self.start = self.count = self.doc = none
        self.anchor = self.name = np.zeros(0, np.uint64)
        if n <= 0:
            return
        sums, down = running(self.data)
        at = np.arange(len(self.data) - anchor + 1)
        hashes = between(sums, down, at, at + anchor)
        lowest = (hashes & ~_LOW) | at.astype(np.uint64)  # equal hashes: the first position
        reach, wanted = 1, least - anchor + 1
        while 2 * reach <= wanted:
            lowest = np.minimum(lowest[:-reach], lowest[reach:])
            reach *= 2
        if wanted > reach:
            lowest = np.minimum(lowest[: reach - wanted], lowest[wanted - reach :])
        sizes = np.diff(self.offsets)
        change = np.zeros(len(self.data) + 1, np.int64)
        whole = sizes >= least
        np.add.at(change, self.offsets[:-1][whole], 1)
        np.add.at(change, self.offsets[1:][whole] - least + 1, -1)
        strings = np.flatnonzero(np.cumsum(change)[:n] > 0)
        if not len(strings):
            return
        position = (lowest[strings] & _LOW).astype(np.int64)
        new = np.ones(len(strings), bool)
        new[1:] = (position[1:] != position[:-1]) | (strings[1:] != strings[:-1] + 1)
        first = np.flatnonzero(new)
        self.start, self.count = strings[first], np.diff(np.append(first, len(strings)))
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        position = position[first]
        self.anchor = hashes[position]
        place = (position - self.start).astype(np.uint64) * np.uint64(3) + self.count.astype(np.uint64)
        self.name = mix(between(sums, down, self.start, self.start + self.count + least - 1) ^ mix(place))

    def again(self) -> np.ndarray:
        """Blocks that stand in their own document more than once."""
        key = self.name + self.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        return counts[back] > 1


def _begins(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows: where the rows with the same keys begin."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def suffix_order(text: np.ndarray, least: int) -> np.ndarray:
    """Positions of all suffixes, the empty one first, sorted by their first ``least`` bytes; ties in any order.

    A suffix is ranked by its first bytes, as the number of suffixes that sort before them; the number of bytes is
    doubled by the rank of what follows. Suffixes that are alone with their rank are not sorted again.
    """
    n = len(text)
    padded = np.zeros(n + 9, np.uint8)
    padded[:n] = text
    width = min(8, least)
    words = np.ndarray((n + 1,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * width)
    left = np.minimum(n - np.arange(n + 1), width)  # a text that ends sorts before one that goes on with zeros
    order = np.argsort(words)
    if not text.all():
        order = np.lexsort((left, words))
    rank = np.empty(n + 1, np.int64)
    rank[order] = _begins(words[order], left[order])
    while width < least:
        open_ = np.flatnonzero(np.bincount(rank)[rank] > 1)
        if not len(open_):
            break
        step = min(width, least - width)
        key = (rank[open_] << 32) | rank[np.minimum(open_ + step, n)]
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        head = rank[open_]
        rank[open_] = head + _begins(key) - _begins(head)
        width += step
    return np.argsort(rank)


def told_apart(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and at which rows a suffix differs from the one before it within ``least`` bytes.

    Row p is told apart at length l if the suffixes without their first byte, which stand at rows ``low`` < ``high``,
    have a row between them told apart at l - 1. Where they are neighbours, the row follows from that one row, one step
    backwards through the transform; only the others look for a row between.
    """
    n = len(text)
    order = suffix_order(text, least)
    row = np.empty(n + 1, np.int64)
    row[order] = np.arange(n + 1)
    first = np.append(text, 0).astype(np.int16)[order]
    first[0] = -1  # the empty suffix
    apart = np.ones(n + 1, bool)
    apart[1:] = first[1:] != first[:-1]
    after = row[np.minimum(order + 1, n)]
    low, high = after[:-1], after[1:]
    step = np.zeros(n + 1, bool)
    step[1:] = ~apart[1:] & (high == low + 1)
    before = row[order - 1]  # row of the suffix one byte longer; the whole text has none
    has_before = order > 0
    wide = np.flatnonzero(~apart[1:] & (high > low + 1)) + 1
    fresh = np.flatnonzero(apart)
    for _ in range(1, least):
        back = before[fresh[has_before[fresh]]]
        back = back[step[back]]
        if len(wide):
            told = np.cumsum(apart, dtype=np.int32)
            hit = told[high[wide - 1]] > told[low[wide - 1]]
            fresh, wide = np.concatenate([back, wide[hit]]), wide[~hit]
        else:
            fresh = back
        if not len(fresh):
            break
        apart[fresh] = True
    return order, apart


def repeated_strings(blocks: list[tuple[bytes, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For all strings of all blocks (bytes, number of strings) in a row: a number that equal ones share, and how many there are."""
    text = np.frombuffer(b"".join(b for b, _ in blocks), np.uint8)
    begin = np.cumsum([0] + [len(b) for b, _ in blocks[:-1]])
    counts = np.array([n for _, n in blocks])
    total = np.cumsum(counts) - counts
    starts = np.repeat(begin - total, counts) + np.arange(counts.sum())
    order, apart = told_apart(text, least)
    kind = np.empty(len(text) + 1, np.int64)
    kind[order] = np.cumsum(apart)
    kind = kind[starts]
    return kind, np.bincount(kind)[kind]


def _ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _compared(least: int, text_bytes: int, group_bytes: int):
    """Blocks sorted by anchor: which of their strings are repeated, as settled rows of ``told_shared``."""

    def told(rows: list[tuple], cut: bool) -> pa.RecordBatch:
        kind, many = repeated_strings([(r[4], r[3]) for r in rows], least)
        key, member, owner, question, settled = [], [], [], [], []
        at = 0
        for _, who, name, count, _, whole in rows:
            if not whole:
                for a, b in _ranges(many[at : at + count] > 1):
                    key.append(a << 32 | b)
                    member.append(name)
                    owner.append(who)
                    question.append(-1)
                    settled.append(True)
            at += count
        if cut:  # one of each kind goes on to meet the strings of the other cuts
            counts = np.array([r[3] for r in rows])
            ends = np.cumsum(counts)
            _, first = np.unique(kind, return_index=True)
            which = np.searchsorted(ends, first, "right")
            for i, j in zip(which.tolist(), (first - (ends - counts)[which]).tolist()):
                block = np.frombuffer(rows[i][4], np.uint8)[j : j + least]
                sums, down = running(block)
                key.append(int(between(sums, down, np.array([0]), np.array([least])).view(np.int64)[0]))
                member.append(rows[i][2])
                owner.append(rows[i][1])
                question.append(j)
                settled.append(False)
        columns = [pa.array(c, pa.int64()) for c in (key, member, owner)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(question, pa.int32()), pa.array(settled, pa.bool_())],
            names=["key", "member", "owner", "question", "settled"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []  # whole groups
        group: list[tuple] = []
        ready_bytes = group_bytes_now = 0
        cut = False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "owner", "name", "count", "bytes", "whole")]
            for r in zip(*columns):
                if group and r[0] != group[-1][0]:
                    if cut:
                        yield told(group, True)
                    else:
                        ready += group
                        ready_bytes += group_bytes_now
                    group, group_bytes_now, cut = [], 0, False
                    if ready_bytes > text_bytes:
                        yield told(ready, False)
                        ready, ready_bytes = [], 0
                if group_bytes_now > group_bytes:
                    yield told(group, True)
                    group, group_bytes_now, cut = [], 0, True
                if group and r[5] and group[-1][5] and r[2] == group[-1][2]:
                    continue  # one copy of a settled block is enough to find its strings elsewhere
                group.append(r)
                group_bytes_now += len(r[4])
        if cut and group:
            yield told(group, True)
        elif group:
            ready += group
        if ready:
            yield told(ready, False)

    return run


def remove_repeated_strings(
    docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text",
    text_bytes: int = TEXT_BYTES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Each document without the bytes of strings of ``least`` bytes that also start anywhere else.

    Columns ``doc_id, n_bytes, n_removed, n_spans`` (longest removed runs) and ``kept`` (the bytes left) of every row.
    Texts are UTF-8; a string lies in one document; another start in the same document counts, overlapping or not;
    strings are judged on the input. Null or empty texts have no bytes; two equal rows repeat each other, and rows
    with one id and different texts are different documents; other columns are not looked at; an empty table gives no
    rows. Blocks and anchors are compared by 64-bit hashes.

    Texts are dealt once and read by three passes. What travels besides: two names for each block of about 70
    strings, of which a batch sends each once, and the bytes of blocks that are neither repeated nor unique.
    """
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    given = given.select(F.xxhash64("doc_id", "text").alias("owner"), "doc_id", "text")
    seed = np.uint64(0x2545F4914F6CDD1D)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(iter([batch]), "text", SLICE):
                b = Blocks(part.column("text"), least, anchor)
                owner = part.column("owner").to_numpy().view(np.uint64)[b.doc]
                found.append((np.concatenate([b.name, b.anchor ^ seed]), np.concatenate([owner, b.name]), np.tile(owner, 2), np.repeat(np.array([0, 1], np.int32), len(owner))))
            if found:
                yield ask_shared(*(np.concatenate(x) for x in zip(*found)))

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            b = Blocks(part.column("text"), least, anchor)
            meets = among(b.name, b.doc, *told_keys(part.column("many")))
            whole = b.again() | among(b.name, b.doc, *told_keys(part.column("full")))
            _, once = np.unique(b.name + b.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
            at = once[meets[once]]
            data = b.data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    signed(b.anchor[at]), part.column("owner").take(pa.array(b.doc[at])), signed(b.name[at]), pa.array(b.count[at]),
                    pa.array([data[s : s + n + least - 1] for s, n in zip(b.start[at].tolist(), b.count[at].tolist())], pa.binary()), pa.array(whole[at]),
                ],
                names=["anchor", "owner", "name", "count", "bytes", "whole"],
            )

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            b = Blocks(part.column("text"), least, anchor)
            whole = b.again() | among(b.name, b.doc, *told_keys(part.column("full")))
            sizes = np.diff(b.offsets)
            copies = part.column("copies").fill_null(1).to_numpy() > 1
            whole |= copies[b.doc]
            change = np.zeros(len(b.data) + 1, np.int64)
            np.add.at(change, b.start[whole], 1)
            np.add.at(change, b.start[whole] + b.count[whole] + least - 1, -1)
            ranges = part.column("ranges")
            where = {(d, m): s for d, m, s in zip(b.doc.tolist(), b.name.view(np.int64).tolist(), b.start.tolist())} if len(ranges) > ranges.null_count else {}
            for i, told in enumerate(ranges.to_pylist()):
                for one in told or ():
                    s = where.get((i, one["name"]))
                    if s is not None:
                        change[s + one["a"]] += 1
                        change[s + one["b"] + least - 1] -= 1
            gone = np.cumsum(change)[:-1] > 0
            lost = np.concatenate([[0], np.cumsum(gone)])
            lost = lost[b.offsets[1:]] - lost[b.offsets[:-1]]
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            edge = b.offsets[:-1][sizes > 0]
            starts[edge] = gone[edge]
            spans = np.concatenate([[0], np.cumsum(starts)])
            spans = spans[b.offsets[1:]] - spans[b.offsets[:-1]]
            left = b.data[~gone].tobytes()
            cuts = np.concatenate([[0], np.cumsum(sizes - lost)]).tolist()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(lost), pa.array(spans), pa.array([left[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    answers = told_shared(given.select("owner", "text").mapInArrow(asked, ROWS)).groupBy("owner").agg(
        F.collect_list(F.when(F.col("question") == 0, F.col("key"))).alias("full"),
        F.collect_list(F.when(F.col("question") == 1, F.col("member"))).alias("many"),
    )
    known = given.join(answers, "owner", "left")
    met = known.mapInArrow(open_blocks, "anchor long, owner long, name long, count long, bytes binary, whole boolean")
    met = met.repartition("anchor").sortWithinPartitions("anchor", "name", "owner")
    told = told_shared(met.mapInArrow(_compared(least, text_bytes, group_bytes), ROWS))
    single = F.col("question") >= 0
    one = F.struct(
        F.col("member").alias("name"),
        F.when(single, F.col("question")).otherwise(F.shiftright("key", 32)).cast("long").alias("a"),
        F.when(single, F.col("question") + 1).otherwise(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))).cast("long").alias("b"),
    )
    ranges = told.groupBy("owner").agg(F.collect_list(one).alias("ranges"))
    copies = given.groupBy("owner").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    kind = given.schema["doc_id"].dataType.simpleString()
    return known.join(ranges, "owner", "left").join(copies, "owner", "left").mapInArrow(
        kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
