"""Joins whose key is heavy on one side: inner ones are split by adaptive execution, outer ones deal the key out."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulon.operators import joins
from tabulon.operators.chunkstore import delete_rows, linked_documents
from tabulon.operators.filters import drill_down_groups
from tabulon.operators.joins import join_tables
from tabulon.operators.stats import with_average_ranks
from tabulon.sources.readers import content_duplicates

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def heavy(spark):
    """A third of 120 000 rows has key 7."""
    return spark.range(0, 120_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("k"),
        F.col("id").alias("row"), F.xxhash64("id").alias("noise"),
    )


CASES = {
    "inner": lambda s, h, k: join_tables(h, k, ["k"], how="inner"),
    "anti": lambda s, h, k: join_tables(h, k.filter("k <> 7"), ["k"], how="anti"),
    "delete": lambda s, h, k: delete_rows(h, k.filter("k < 7"), "k"),
    "drill": lambda s, h, k: drill_down_groups(h, k, ["k"]),
    "linked": lambda s, h, k: linked_documents(k, h, "k", "k", "row"),
    "duplicates": lambda s, h, k: content_duplicates(h.withColumn("id", F.sha2(F.col("row").cast("string"), 512)), "id", "k"),
    "ranks": lambda s, h, k: with_average_ranks(h, ["k", "noise"]),
}


@pytest.mark.parametrize("name", CASES)
def test_heavy_key_is_split(small_partitions, name):
    spark = small_partitions
    keys = spark.range(6000).select(F.col("id").alias("k"))
    out = CASES[name](spark, heavy(spark), keys)
    result = out.agg(F.max(F.xxhash64(*out.columns)))
    result.collect()
    assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins_deal_heavy_keys_and_missing_keys(spark, monkeypatch, tmp_path, how, adaptive):
    """Each side is read whole and shuffled whole once; a key of a third of the rows, on either side, fills no task."""
    monkeypatch.setattr(joins, "HEAVY_ROWS", 2_000)
    n = 30_000
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 5000)
    spark.range(0, n, 1, 4).select(key.alias("k"), F.col("id").alias("row")).write.parquet(str(tmp_path / "long"))
    few = spark.range(2000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("other"))
    lone = spark.range(4000).select(F.lit(-5).cast("long").alias("k"), F.col("id").alias("other"))
    few.unionAll(lone).write.parquet(str(tmp_path / "short"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for long_first in (True, False):
            a, b = (spark.read.parquet(str(tmp_path / x)) for x in (("long", "short") if long_first else ("short", "long")))
            out = join_tables(a, b, ["k"], how=how)
            plan = out._jdf.queryExecution().executedPlan().toString()
            for column in ("row", "other"):
                wide = [line for line in plan.splitlines() if "FileScan" in line and column in line.split("Batched")[0]]
                assert len(wide) == 1
            assert sum("Exchange hashpartitioning" in line and "__salt" in line for line in plan.splitlines()) == 2
            wanted = sorted(map(str, a.withColumnRenamed("k", "x").join(b.withColumnRenamed("k", "y"), F.col("x") == F.col("y"), how).select("row", "other").collect()))
            tasks = out.select("row", "other").withColumn("task", F.spark_partition_id())
            found = tasks.collect()
            assert sorted(str(r).split(", task")[0].replace(")", "") for r in found) == [w.replace(")", "") for w in wanted]
            if adaptive == "false":
                sizes = sorted(Counter(r["task"] for r in found).values())
                assert sizes[-1] < 4 * len(found) / 16 + 4_000
    finally:
        for name, value in zip(("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions"), before):
            spark.conf.set(name, value)


def test_copies_without_partners_in_their_task_leave_no_rows(spark, monkeypatch):
    """Keys that are heavy on both sides, on one, and by one row more than allowed, by two keys of different types."""
    monkeypatch.setattr(joins, "HEAVY_ROWS", 3)
    left = spark.createDataFrame([(1, "a", i) for i in range(4)] + [(2, "a", 9), (3, None, 1)] * 2 + [(5, "b", i) for i in range(8)], "k int, s string, v int")
    right = spark.createDataFrame([(1, "a", i) for i in range(3)] + [(2, "a", i) for i in range(9)] + [(6, "b", i) for i in range(7)] + [(None, "a", 1)], "k long, s string, w int")
    for how in ("left", "right", "full"):
        out = join_tables(left, right, ["k", "s"], how=how).select("v", "w")
        plain = left.withColumnsRenamed({"k": "a", "s": "b"}).join(right, (F.col("a") == F.col("k")) & (F.col("b") == F.col("s")), how).select("v", "w")
        assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
