"""WARC records and a Merkle audit of two copies of an archive.

A tree stands over the ordered record ids: a node covers an aligned range of ids, sixteen times wider on each level,
and with it a range of bytes of the archive. It keeps the bytes of its range and a hash of its children's hashes.
Copies are compared from the root; only children of nodes that differ are looked at, and their offsets follow from
the sizes of the nodes before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.session import computed_once, scratch_path

BITS = 4  # a node has 2 ** BITS children at most


def warc_record(url: Column, payload: Column) -> Column:
    """A response record; null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame, record_id: str, record: Column, no_id: int) -> DataFrame:
    """``key, hash, bytes``: one row per id. Repeated records are counted before anything is gathered."""
    key = F.coalesce(F.col(f"`{record_id}`").cast("long"), F.lit(no_id))
    each = records.select(key.alias("key"), F.sha2(record, 256).alias("hash"), F.octet_length(record).cast("long").alias("bytes"))
    counted = each.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    several = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hash", "n"))), lambda x: F.concat_ws(":", x["hash"], x["n"])), ",")
    return counted.groupBy("key").agg(
        F.when((F.count(F.lit(1)) == 1) & (F.max("n") == 1), F.max("hash")).otherwise(F.sha2(several, 256)).alias("hash"),
        F.sum("bytes").alias("bytes"),
    )


def tree(records: DataFrame, record_id: str, record: Column, levels: int, no_id: int) -> list[DataFrame]:
    """The nodes of each level, from the leaves to the root; each level is kept in the checkpoint folder."""
    made = [computed_once(leaves(records, record_id, record, no_id))]
    for level in range(levels):
        last = level == levels - 1
        up = F.lit(0).cast("long") if last else F.shiftright("key", BITS)
        child = F.struct("key", "hash", "bytes")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["key"], c["hash"], c["bytes"])), ",")
        made.append(computed_once(made[-1].groupBy(up.alias("key")).agg(F.sha2(joined, 256).alias("hash"), F.sum("bytes").alias("bytes"))))
    return made


def key_range(*copies: DataFrame, record_id: str) -> tuple[int, int]:
    """Levels above the leaves until one node covers all ids, and the key of records without one, before all others."""
    key = F.col(f"`{record_id}`").cast("long")
    found = [x for copy in copies for x in copy.agg(F.min(key), F.max(key)).first() if x is not None]
    no_id = min(found, default=0) - 1
    widest = max(abs(x + (x < 0)).bit_length() for x in (no_id, *found))
    return -(-widest // BITS) + 1, no_id


def audit(
    original: DataFrame, replica: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html"
) -> DataFrame:
    """Records of two copies that differ, found by descending from the roots.

    Columns: the id, ``status`` (``changed``, ``missing`` in the replica, ``added`` there), ``offset`` and ``length`` (bytes
    of the original archive, records in order of id; an added record has the offset where it would stand and no
    length), ``sha256`` and ``replica_sha256``. An id with several records is one leaf, its hash made of theirs and
    their numbers. Null ids are one leaf before all others; null parts are empty; other columns are not looked at;
    equal copies and two empty tables give no rows. Each copy is read twice: for the range of its ids and for its leaves.
    """
    kind = original.schema[record_id].dataType
    record = warc_record(F.col(f"`{url}`"), F.col(f"`{payload}`"))
    levels, no_id = key_range(original, replica, record_id=record_id)
    one, two = (tree(copy, record_id, record, levels, no_id) for copy in (original, replica))
    differ = None
    for level in range(levels, -1, -1):
        a = one[level].select("key", F.col("hash").alias("hash_a"), F.col("bytes").alias("bytes_a"))
        b = two[level].select("key", F.col("hash").alias("hash_b"))
        if level >= levels - 1:
            # The root, and its two children at most: identifiers below zero and the others.
            both = a.join(b, "key", "full").withColumn("parent", F.col("key") - F.col("key")).withColumn("base", F.lit(0).cast("long"))
        else:
            suspects = differ.select(F.col("key").alias("parent"), F.col("at").alias("base"))
            a, b = (x.withColumn("parent", F.shiftright("key", BITS)).join(suspects, "parent") for x in (a, b))
            both = a.drop("base").join(b.select("key", "hash_b"), "key", "full").withColumn("parent", F.shiftright("key", BITS)).join(suspects, "parent")
        siblings = Window.partitionBy("parent").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumn("at", F.col("base") + F.coalesce(F.sum("bytes_a").over(siblings), F.lit(0)))
        # Written, so that the next level reads these few nodes and neither all that led to them nor what the optimizer
        # knows about it, which would double with each level.
        differ = both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("key", "hash_a", "hash_b", "bytes_a", "at")
        path = scratch_path(original.sparkSession, "differing")
        differ.write.parquet(path)
        differ = original.sparkSession.read.schema(differ.schema).parquet(path)
        if differ.isEmpty():
            break
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "added").otherwise("changed")
    return differ.select(
        F.when(F.col("key") != no_id, F.col("key")).cast(kind).alias(record_id), status.alias("status"),
        F.col("at").alias("offset"), F.col("bytes_a").alias("length"),
        F.col("hash_a").alias("sha256"), F.col("hash_b").alias("replica_sha256"),
    )
