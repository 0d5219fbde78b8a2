"""A Merkle manifest of a dataset: a tree over each group of rows, and one over the groups' roots.

Where a row stands in its group is read from an index of bitmaps and not found by sorting rows. The ids of a group are a
bitmap kept as its words that are not zero; words of all tasks are merged by OR. A directory counts the rows before each word,
over three levels, so that no count runs over more than a bounded number of entries. A row's place is the count before
its word plus the bits below its own. Rows are then put into arrays by place, ``WIDTH`` slots each, and an array is
reduced by ``LEVELS`` levels of the tree at once; the arrays' roots are put into arrays again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.operators.ordering import row_numbers
from tabulon.session import computed_once

FANOUT = 3
LEVELS = 5
WIDTH = FANOUT**LEVELS
_WORD_BITS = 6  # a word of the bitmap holds 64 ids
_STEP_BITS = 20  # a level of the directory covers so many bits of the words' numbers
_NO_ID = -(1 << 57) - 1  # the word of rows without id, before all others
_PREFIX = 12  # rows that share an id are counted by so many bits of their hash first


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Hash of the fields in a row: ``-`` for null, else number of bytes, ``:`` and value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def proof_digest(path: Column) -> Column:
    """Hash of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings on a path."""
    return F.aggregate(path, leaf, lambda at, p: F.sha2(F.concat(p["before"], at, p["after"]), 256))


# --- places by bitmaps ------------------------------------------------------------------------


def _running(keys: Sequence[str], order: Sequence[str]) -> Column:
    """Rows counted before an entry; the window runs over entries of the directory, not over rows."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(before), F.lit(0))


def bitmap_index(rows: DataFrame) -> DataFrame:
    """``group, word, bits, n, before, total``: the words of each group's bitmap that are not zero, the rows in each, the
    rows before it and all rows of the group. Rows: ``group`` and ``id`` (long)."""
    bit = F.coalesce(F.col("id"), F.lit(0)).bitwiseAND(63).cast("int")
    word = F.coalesce(F.shiftright("id", _WORD_BITS), F.lit(_NO_ID))
    words = rows.select("group", word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("group", "word").agg(
        F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n")
    )
    words = computed_once(words.withColumn("mid", F.shiftright("word", _STEP_BITS)).withColumn("high", F.shiftright("word", 2 * _STEP_BITS)))
    mid = words.groupBy("group", "high", "mid").agg(F.sum("n").alias("n"))
    high = mid.groupBy("group", "high").agg(F.sum("n").alias("n"))
    total = high.groupBy("group").agg(F.sum("n").alias("total"))
    high = high.select("group", "high", _running(["group"], ["high"]).alias("before_high")).join(total, "group")
    mid = mid.select("group", "high", "mid", _running(["group", "high"], ["mid"]).alias("before_mid")).join(high, ["group", "high"])
    inside = words.select("group", "mid", "word", "bits", "n", _running(["group", "mid"], ["word"]).alias("before_word"))
    before = F.col("before_word") + F.col("before_mid") + F.col("before_high")
    return inside.join(mid.drop("high"), ["group", "mid"]).select("group", "word", "bits", "n", before.alias("before"), "total")


def _ordinals(rows: DataFrame) -> DataFrame:
    """Rows of words in which ids are repeated, with ``ordinal``: their place in the word by id, hash and row.

    Rows of one id are counted by the first bits of their hash, equal rows by the task they come from; a window runs
    over those counts, and over the rows that one task gave to one hash.
    """
    id_, prefix = F.coalesce("id", F.lit(0)), F.substring(F.hex("leaf"), 1, _PREFIX // 4)
    keyed = rows.withColumn("same", id_).withColumn("prefix", prefix).withColumn("part", F.shiftright("row", 33))
    one = F.count(F.lit(1)).alias("n")
    fine = keyed.groupBy("group", "word", "same", "prefix", "leaf", "part").agg(one)
    coarse = fine.groupBy("group", "word", "same", "prefix").agg(F.sum("n").alias("n"))
    coarse = coarse.withColumn("before_prefix", _running(["group", "word"], ["same", "prefix"])).drop("n")
    fine = fine.withColumn("before_leaf", _running(["group", "word", "same", "prefix"], ["leaf", "part"])).drop("n")
    both = fine.join(coarse, ["group", "word", "same", "prefix"])
    alike = Window.partitionBy("group", "word", "same", "prefix", "leaf", "part").orderBy("row")
    numbered = keyed.withColumn("last", F.row_number().over(alike)).join(both, ["group", "word", "same", "prefix", "leaf", "part"])
    return numbered.withColumn("ordinal", F.col("before_prefix") + F.col("before_leaf") + F.col("last") - 1)


def placed(rows: DataFrame) -> DataFrame:
    """The rows with ``slot``, their place in the group by id (none first, repeated ones by hash), and the group's ``total``.

    Rows: ``group``, ``id``, ``leaf`` (binary hash) and ``row`` (a number of their own), computed once.
    """
    index = computed_once(bitmap_index(rows))
    word = F.coalesce(F.shiftright("id", _WORD_BITS), F.lit(_NO_ID))
    rows = rows.withColumn("word", word)
    names = [*[c for c in rows.columns if c != "word"], "slot", "total"]
    repeated = F.col("n") > F.bit_count("bits")
    above = F.lit(63) - F.col("id").bitwiseAND(63).cast("int")
    below = F.shiftrightunsigned(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), above), 1)
    rank = F.when(F.col("id").isNotNull(), F.bit_count(F.col("bits").bitwiseAND(below))).otherwise(0)
    found = rows.join(index.where(~repeated), ["group", "word"]).withColumn("slot", F.col("before") + rank).select(*names)
    several = index.where(repeated)
    if several.isEmpty():
        return found
    those = _ordinals(rows.join(several.select("group", "word", "before", "total"), ["group", "word"]))
    return found.unionByName(those.withColumn("slot", F.col("before") + F.col("ordinal")).select(*names))


# --- levels by slot arrays --------------------------------------------------------------------


def _hex(hash_: Column) -> Column:
    return F.lower(F.hex(hash_))


def _div(x: Column, by: int) -> Column:
    return F.floor(x / F.lit(by)).cast("int")


def _arrays(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """``group, block, total, slots, top``: ``WIDTH`` consecutive nodes each, by slot, and the hash they come to.

    Nodes: ``group, slot, hash`` (binary), ``total`` (nodes of the group) and the payload.
    """
    inside = F.struct((F.col("slot") % WIDTH).cast("int").alias("at"), "hash", *payload)
    blocks = nodes.groupBy("group", F.floor(F.col("slot") / F.lit(WIDTH)).alias("block")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(inside)).alias("slots")
    )
    return _with_levels(blocks).select("group", "block", "total", "slots", F.unhex(F.col(f"level{LEVELS}")[0]).alias("top"))


def _with_levels(blocks: DataFrame) -> DataFrame:
    """The hashes of a block's nodes on each level. A group of one block stops where one node remains; where there are
    more blocks, several nodes remain on all of these levels."""
    def up(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), _div(F.size(nodes) - 1, FANOUT))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))

    out = blocks.withColumn("level0", F.transform("slots", lambda s: _hex(s["hash"])))
    for level in range(LEVELS):
        nodes = F.col(f"level{level}")
        out = out.withColumn(f"level{level + 1}", F.when(_goes_on(level), up(nodes)).otherwise(nodes))
    return out


def _goes_on(level: int) -> Column:
    """Whether several nodes of the group remain on a level."""
    return F.col("total") > FANOUT**level


def _opened(blocks: DataFrame) -> DataFrame:
    """One row per node of blocks that have a ``path`` of their own: ``node`` (its struct), ``path`` and the other columns."""
    def step(i: Column, level: int) -> Column:
        p = _div(i, FANOUT**level)
        nodes, at = F.col(f"level{level}"), p % FANOUT
        before = F.array_join(F.slice(nodes, p - at + 1, at), "")
        after = F.array_join(F.slice(nodes, p + 2, F.lit(FANOUT - 1) - at), "")
        return F.when(_goes_on(level), F.struct(before.alias("before"), after.alias("after")))

    def node(s: Column, i: Column) -> Column:
        own = F.array_compact(F.array(*[step(i, level) for level in range(LEVELS)]))
        return F.struct(s.alias("node"), F.concat(own, F.col("path")).alias("path"))

    kept = [c for c in blocks.columns if c not in ("slots", "path", "top", "total")]
    return _with_levels(blocks).select(*kept, F.inline(F.transform("slots", node)))


def _reduced(nodes: DataFrame, payload: Sequence[str] = ()) -> list[DataFrame]:
    """The blocks of each round, until every group has come to one node; each is computed once."""
    rounds = [computed_once(_arrays(nodes, payload))]
    while True:
        most = rounds[-1].agg(F.max("total")).first()[0]
        if most is None or most <= WIDTH:
            return rounds
        above = F.ceil(F.col("total") / F.lit(WIDTH)).cast("long")
        rounds.append(computed_once(_arrays(rounds[-1].select("group", F.col("block").alias("slot"), F.col("top").alias("hash"), above.alias("total")))))


def _paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first round with their paths. ``above``: ``group``, ``path`` from the group's root on, and what goes with it."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    carried = [c for c in above.columns if c not in ("group", "block", "path")]
    for i in reversed(range(len(rounds))):
        opened = _opened(rounds[i].join(above, ["group", "block"]))
        if not i:
            return opened
        slot = F.col("block") * WIDTH + F.col("node.at")
        above = opened.select("group", slot.alias("block"), "path", *carried)


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source",
    doc_id: str = "doc_id", presented: Column | None = None,
) -> DataFrame:
    """The place of every row in the tree and the path from it to the root.

    Columns: ``doc_id``, ``leaf`` (``leaf_hash`` of ``fields``), ``subroot``, ``root``, ``path`` (from the leaf on, for each level the
    siblings ``before`` and ``after``, joined) and, where given, ``presented`` (a hash in hex of each row, kept beside it).
    Leaves of one group ascend by ``doc_id``, a whole number; runs of three become their hash until one node remains, its
    subroot; subroots by group (null first, by bytes) come to the root in the same way. Rows without id stand first in
    their group; rows with the same id by leaf; equal rows follow each other. Any value may be null or empty, other
    columns are not looked at, an empty table has no rows. Texts are read once; after that a row is its id and hashes.
    """
    leaf = leaf_hash([F.col(f"`{f}`") for f in fields])
    other = presented if presented is not None else F.lit(None).cast("string")
    name = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    rows = docs.select(
        name.alias("group"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{doc_id}`").alias("given"), F.unhex(leaf).alias("leaf"),
        F.unhex(other).alias("presented"), F.monotonically_increasing_id().alias("row"),
    )
    payload = ["given", "presented"]
    nodes = placed(computed_once(rows)).withColumnRenamed("leaf", "hash")
    rounds = _reduced(nodes.select("group", "slot", "hash", "total", *payload), payload)
    subroots = rounds[-1].select(F.col("group").alias("name"), F.col("top").alias("hash"))
    numbered = row_numbers(subroots, ["name"], "number")
    count = subroots.count()
    top = _reduced(numbered.select(
        F.lit("").alias("group"), (F.col("number") - 1).alias("slot"), "hash", F.lit(count).cast("long").alias("total"), "name"
    ), ["name"])
    root = top[-1].select("group", F.array().cast("array<struct<before: string, after: string>>").alias("path"), _hex(F.col("top")).alias("root"))
    groups = _paths(top, root).select(F.col("node.name").alias("group"), "path", _hex(F.col("node.hash")).alias("subroot"), "root")
    out = [F.col("node.given").alias("doc_id"), _hex(F.col("node.hash")).alias("leaf"), "subroot", "root", "path"]
    if presented is not None:
        out.append(_hex(F.col("node.presented")).alias("presented"))
    return _paths(rounds, groups).select(*out)
