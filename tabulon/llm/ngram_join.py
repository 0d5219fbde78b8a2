"""Similarity join of n-gram sets: candidates by shared beginnings of ordered sets, then a prefix tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.arrays import LOWER, SPACE, flat, mix, run_hashes, signed, slices, spans, unsigned, word_hashes
from tabulon.llm.components import components
from tabulon.session import computed_once

WIDTH = 5
PERCENT = 80
# Grams that at least this share of the documents hold come last in the global order; the list of them is sent to
# every task, so it has a fixed length. It decides about speed only: any order gives the same links.
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_MOST = 1 / 1000, 8, 1 << 20
# A set's first grams reach so far beyond the shortest possible number: by a part of its size.
SPARE = 10
# Up to so many sets of a gram are counted to put rare grams first.
COUNTED = 1000
# Grams that one task holds at a time; larger groups of candidates are compared block by block.
BLOCK_GRAMS = 2_000_000
_FIRST = np.uint64(1 << 63)


def gram_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-gram sets of all texts in a row, each sorted, and where each begins."""
    data, offsets = flat(texts)
    low = LOWER[data]
    starts, ends, doc = spans(low, offsets, SPACE)
    names = word_hashes(low, starts, ends)
    words = np.bincount(doc, minlength=len(texts))
    grams = run_hashes(names, width)
    inside = doc[: len(grams)] == doc[width - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[inside], doc[: len(grams)][inside]
    first = np.cumsum(words) - words
    for k in range(1, width):  # too few words for a gram: the whole text is one
        few = np.flatnonzero(words == k)
        if len(few):
            each = names[first[few][:, None] + np.arange(k)]
            total = (each * np.array([pow(3, 2 * j + 1, 1 << 64) for j in range(k)], np.uint64)).sum(axis=1, dtype=np.uint64)
            grams, owner = np.concatenate([grams, mix(total + np.uint64(k))]), np.concatenate([owner, few])
    if np.any(np.diff(owner) < 0):
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[fresh], np.searchsorted(owner[fresh], np.arange(len(texts) + 1))


def set_names(grams: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set; equal sets have equal names."""
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix(sums[edges[1:]] - sums[edges[:-1]] + np.diff(edges).astype(np.uint64))


def _distinct(names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each non-empty set of a batch is met first."""
    at = np.unique(names, return_index=True)[1]
    return np.sort(at[sizes[at] > 0])


def _ordered(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys of the global order: frequent grams after all others."""
    keys = grams >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        keys = np.where(frequent[at] == grams, keys | _FIRST, keys)
    return keys


def _prefix(size: np.ndarray, percent: int) -> np.ndarray:
    """How many first grams of a set are looked at.

    Linked sets x and y share at least o = ceil(percent/100 * max(|x|, |y|)) grams, so the first |x| - o + l of x and
    the first |y| - o + l of y share l. With l = |x| / SPARE, and partners of at least percent/100 * |x|, at least
    percent/100 * |x| / SPARE (``_need``) of the grams looked at are shared with the partner.
    """
    return np.minimum(size, size - -(-size * percent // 100) + -(-size // SPARE))


def _need(n: Column, percent: int) -> Column:
    return F.greatest(F.lit(1), F.floor(n * percent / (100 * SPARE))).cast("int")


def _described(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, digest, n, name`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            grams, edges = gram_sets(part.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), pa.array(np.diff(edges)), signed(set_names(grams, edges))],
                names=["doc_id", "digest", "n", "name"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest long, n long, name long")


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Grams that very many different sets hold, as counted batch by batch; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, seen, n = [], [], 0
            for part in slices(iter([batch]), "text"):
                grams, edges = gram_sets(part.column("text"), width)
                names = set_names(grams, edges)
                first = _distinct(names, np.diff(edges))
                first = first[~np.isin(names[first], np.concatenate(seen))] if seen else first
                seen.append(names[first])
                keep = np.zeros(len(names), bool)
                keep[first] = True
                held.append(grams[np.repeat(keep, np.diff(edges))])
                n += len(first)
            grams, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= max(3, n * FREQUENT_SHARE)
            yield pa.RecordBatch.from_arrays([signed(grams[often]), pa.array(counts[often])], names=["gram", "n"])

    least = max(FREQUENT_LEAST, docs.count() * FREQUENT_SHARE)
    found = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    kept = found.where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(FREQUENT_MOST).select("gram")
    return np.sort(kept.toArrow().column("gram").to_numpy().astype(np.int64).view(np.uint64))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, name, n), sorted: those whose key belongs to several names, each once, with their number.

    The number stops at ``COUNTED``, so that no more rows of a key are held back; it puts rare keys first later on.
    """
    held = [np.zeros(0, np.int64)] * 3
    full = None  # a key that has reached the number, whose rows are passed on as they come

    def told(columns, counts):
        keep = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*columns, counts)], names=["key", "name", "n", "held"])

    for batch in batches:
        columns = [np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate(held)]
        key, name = columns[:2]
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        columns = [c[fresh] for c in columns]
        key = columns[0]
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(edges)
        counts = np.minimum(sizes, COUNTED)
        if full is not None and key[0] == full:
            counts[0] = COUNTED
        full = int(key[-1]) if counts[-1] == COUNTED else None
        wait = edges[-2] if full is None else len(key) - 1  # the last row shows whether a name goes on
        counts = np.repeat(counts, sizes)
        yield told([c[:wait] for c in columns], counts[:wait])
        held = [c[wait:] for c in columns]
    if len(held[0]):
        yield told(held, np.full(len(held[0]), COUNTED if full is not None else len(held[0])))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, name), sorted: a link from each name to the first one of its key."""
    key_before, first_before = None, None
    for batch in batches:
        key, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        begins = np.ones(len(key), bool)
        begins[1:] = key[1:] != key[:-1]
        at = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
        first = name[at]
        if key_before is not None and key[0] == key_before:
            first = np.where(key == key_before, first_before, first)
        key_before, first_before = key[-1], first[-1]
        pairs = np.stack([name, first], axis=1)[name != first]
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        pairs = pairs[new]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


class _Node:
    """A path-compressed node: grams on the way to it, sizes of the sets below, and whether they are known to be linked."""

    __slots__ = ("grams", "below", "members", "least", "most", "one", "uniform")

    def __init__(self, grams: np.ndarray) -> None:
        self.grams, self.below, self.members = grams, {}, []
        self.least, self.most, self.one, self.uniform = 1 << 60, 0, -1, True


class PrefixTree:
    """Sets as sorted ranks, inserted after they were compared with all sets before them.

    ``size`` counts all grams of a set, also those that no other set has and that are therefore not in the tree.
    """

    def __init__(self, percent: int) -> None:
        self.percent, self.root = percent, _Node(np.zeros(0, np.int32))
        self.sizes: list[int] = []
        self.lead: list[int] = []

    def _find(self, x: int) -> int:
        lead = self.lead
        while lead[x] != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    def new(self, size: int) -> int:
        self.sizes.append(size)
        self.lead.append(len(self.lead))
        return len(self.lead) - 1

    def links(self, member: int, ranks: np.ndarray) -> list[int]:
        """Earlier sets linked to this one, one at least of each group it is linked to."""
        n, p, found = self.sizes[member], self.percent, []
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, overlap, depth, at = stack.pop()
            if node.uniform and node.one >= 0 and self._find(node.one) == self._find(member):
                continue
            if len(node.grams):
                place = np.searchsorted(ranks[at:], node.grams) + at
                hit = place < len(ranks)
                hit[hit] = ranks[place[hit]] == node.grams[hit]
                overlap += int(np.count_nonzero(hit))
                depth += len(node.grams)
                at = int(place[-1]) + bool(hit[-1])
            # depth and most count grams in the tree, least is the smallest size of a set below
            best = overlap + min(node.most - depth, len(ranks) - at)
            if best * (100 + p) < p * (n + node.least):
                continue
            for other in node.members:
                a, b = self._find(other), self._find(member)
                if a != b and overlap * (100 + p) >= p * (n + self.sizes[other]):
                    self.lead[max(a, b)] = min(a, b)
                    found.append(other)
            own = int(ranks[at]) if at < len(ranks) else -1
            for first, child in node.below.items():
                if first != own:
                    stack.append((child, overlap, depth, at))
            if own in node.below:  # the way of the set itself is looked at first
                stack.append((node.below[own], overlap, depth, at))
        return found

    def insert(self, member: int, ranks: np.ndarray) -> None:
        node, at = self.root, 0
        path = [node]
        while at < len(ranks):
            child = node.below.get(int(ranks[at]))
            if child is None:
                child = node.below[int(ranks[at])] = _Node(ranks[at:])
                at = len(ranks)
            else:
                m = min(len(child.grams), len(ranks) - at)
                apart = np.flatnonzero(child.grams[:m] != ranks[at : at + m])
                same = int(apart[0]) if len(apart) else m
                if same < len(child.grams):
                    upper = _Node(child.grams[:same])
                    upper.least, upper.most, upper.one, upper.uniform = child.least, child.most, child.one, child.uniform
                    upper.below[int(child.grams[same])] = child
                    child.grams = child.grams[same:]
                    node.below[int(ranks[at])] = child = upper
                at += same
            node = child
            path.append(node)
        node.members.append(member)
        for x in path:
            x.least, x.most = min(x.least, self.sizes[member]), max(x.most, len(ranks))
            if x.one < 0:
                x.one = member
            elif x.uniform:
                x.uniform = self._find(x.one) == self._find(member)


def linked_pairs(sets: list[np.ndarray], percent: int, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join all linked sets of a group; with two sides, those between sets of different sides."""
    sizes = np.array([len(x) for x in sets], np.int64)
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids, counts = np.unique(grams, return_inverse=True, return_counts=True)
    alive = np.ones(len(sets), bool)
    while True:  # a set most of whose grams are its own has no partner
        held = np.bincount(ids, weights=alive[owner], minlength=len(counts))
        common = np.bincount(owner, weights=held[ids] > 1, minlength=len(sets))
        now = alive & (common * 100 >= percent * sizes) & (sizes > 0)
        if (now == alive).all():
            break
        alive = now
    use = alive[owner] & (held[ids] > 1)
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(-held, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    ranks, owner = rank[ids[use]], owner[use]
    order = np.lexsort((ranks, owner))
    ranks = ranks[order]
    edges = np.searchsorted(owner, np.arange(len(sets) + 1))
    mine = [ranks[edges[i] : edges[i + 1]] for i in range(len(sets))]
    tree, found, where = PrefixTree(percent), [], []
    turn = sorted(np.flatnonzero(alive).tolist(), key=lambda i: (side[i] if side else 0, mine[i].astype(">i4").tobytes()))
    for i in turn:
        member = tree.new(int(sizes[i]))
        where.append(i)
        if side is None or side[i]:
            found += [(where[other], i) for other in tree.links(member, mine[i])]
        if side is None or not side[i]:
            tree.insert(member, mine[i])
    return found


def _joined(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, i, j, block, name, grams), sorted by group: the links of each group."""

        def told(key, rows):
            _, i, j = key
            sets = [np.frombuffer(g, np.uint64) for _, _, g in rows]
            side = None if i == j else [int(b == j) for b, _, _ in rows]
            found = linked_pairs(sets, percent, side)
            a, b = ([rows[pair[k]][1] for pair in found] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        key, rows, names = None, [], set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "block", "name")]
            for component, i, j, block, name, grams in zip(*columns, batch.column("grams")):
                if (component, i, j) != key:
                    if len(rows) > 1:
                        yield told(key, rows)
                    key, rows, names = (component, i, j), [], set()
                if name not in names:
                    names.add(name)
                    rows.append((block, name, grams.as_py()))
        if len(rows) > 1:
            yield told(key, rows)

    return run


def similar_documents(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: groups of documents whose word n-grams agree.

    Words are runs without ASCII white space, A-Z lower-cased. A document's set holds its distinct runs of ``width``
    words; with fewer words the whole text is one; without words (or null) it is empty and linked with nothing. Two
    documents are linked when 100 * |intersection| >= ``percent`` * |union|; ``component_id`` is the smallest id
    reachable by links. Repeated rows are linked with each other; a null id takes part and gets the component's
    smallest id; other columns are not looked at. Sets are compared by 64-bit hashes of their grams.

    1. Equal sets are one class from here on, whatever their number.
    2. Classes emit the first grams of their set in a global order. Those no other class has are dropped, then classes
       that share too few. Partners share a known number of the rest, so all but one of these may be left out: the
       most frequent. Classes left that share a gram are drawn together into groups, of which each link lies in one;
       a gram that many classes share costs a star of links, not their pairs.
    3. Each group's sets meet in one prefix tree. A group larger than ``block_grams`` is compared block with block.
    4. Links that join everything linked are kept (not one for every pair), and components are found in Spark rounds.
    """
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    given = given.withColumn("digest", F.xxhash64("text"))
    described = computed_once(_described(given, width))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(given, width))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            grams, edges = gram_sets(part.column("text"), width)
            sizes, names = np.diff(edges), set_names(grams, edges)
            first = _distinct(names, sizes)
            most = _prefix(sizes, percent)
            keys = _ordered(grams, frequent.value)
            out = []
            for i in first.tolist():
                own = keys[edges[i] : edges[i + 1]]
                k = int(most[i])
                out.append(np.partition(own, k - 1)[:k] if k < len(own) else own)
            yield pa.RecordBatch.from_arrays(
                [signed(np.concatenate(out)) if out else pa.array([], pa.int64()), signed(np.repeat(names[first], most[first])), pa.array(np.repeat(sizes[first], most[first]))],
                names=["key", "name", "n"],
            )

    rows = given.select("text").mapInArrow(prefixes, "key long, name long, n long")
    rows = rows.repartition("key").sortWithinPartitions("key", "name").mapInArrow(_shared, "key long, name long, n long, held long")
    rows = rows.groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("keys"))
    need = _need(F.col("n"), percent)
    rarest = F.slice("keys", F.lit(1), F.size("keys") - need + 1)
    stars = (
        rows.where(F.size("keys") >= need).select("name", F.explode(rarest).alias("one")).select("one.key", "name")
        .repartition("key").sortWithinPartitions("key", "name").mapInArrow(_stars, "a long, b long")
    )
    groups = components(stars)
    # The row that stands for a class is found by id and text: ids alone may be null or repeated, and texts copied.
    classes = described.groupBy("name").agg(
        F.min("doc_id").alias("first"), F.max("n").alias("n"), F.min(F.struct("digest", "doc_id")).alias("picked")
    )
    wanted = computed_once(groups.join(classes, F.col("node") == F.col("name")).select("name", "component", "picked", "n"))
    blocks = wanted.groupBy("component").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("blocks"))
    wanted = wanted.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            grams, edges = gram_sets(part.column("text"), width)
            names = set_names(grams, edges)
            same = np.flatnonzero(names == unsigned(part.column("name")))
            same = same[np.sort(np.unique(names[same], return_index=True)[1])]  # equal rows of a class once
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(same)) for c in ("name", "component", "block", "blocks")), pa.array([grams[edges[i] : edges[i + 1]].tobytes() for i in same], pa.binary())],
                names=["name", "component", "block", "blocks", "grams"],
            )

    met = (
        given.join(wanted, (given["digest"] == wanted["picked.digest"]) & given["doc_id"].eqNullSafe(wanted["picked.doc_id"])).select("text", "name", "component", "block", "blocks")
        .mapInArrow(sets, "name long, component long, block int, blocks int, grams binary")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .select("component", "i", "j", "block", "name", "grams")
        .repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "name")
    )
    linked = components(met.mapInArrow(_joined(percent), "a long, b long"))
    named = linked.join(classes, F.col("node") == F.col("name")).select("name", "component", "first")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    found = classes.join(named.drop("first").join(smallest, "component"), "name", "left").where(F.col("n") > 0)
    found = found.select("name", F.coalesce("component_id", "first").alias("component_id"))
    return described.join(found, "name", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )

