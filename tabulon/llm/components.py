"""Connected components of links between 64-bit names, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulon.session import computed_once


# In so many rounds the smallest node wins, which settles stars around it; later ones draw lots, which settles chains.
ROUNDS_BY_NODE = 3


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a``, ``b``): nodes that links join have the same component,
    which is one of them.

    Each round points every node to the first of itself and its neighbours, in an order of that round, and from there
    one step further, and draws the links between the nodes pointed to; links inside one such node vanish. In an order
    drawn by lot, a constant share of the nodes is expected to go in each round. The neighbours of a node are only
    ever aggregated, so a node may have any number of them.
    """
    left = computed_once(_drawn(links))
    steps: list[DataFrame] = []
    while not left.isEmpty():
        def place(node: str):
            lot = F.lit(0).cast("long") if len(steps) < ROUNDS_BY_NODE else F.xxhash64(node, F.lit(len(steps)))
            return F.struct(lot.alias("lot"), F.col(node).alias("node"))

        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(place("b")).alias("first"))
        near = near.select(F.col("a").alias("node"), F.least("first", place("a"))["node"].alias("to"))
        far = near.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = computed_once(near.join(far, "to").select("node", F.col("further").alias("to")))
        steps.append(step)
        one, two = (step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        moved = left.join(one, "a").join(two, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = computed_once(_drawn(moved))
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    found = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("component"), F.col("to").alias("final"))
        found = found.join(onward, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    return computed_once(found)


def _drawn(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
