"""Connected components by alternating large and small stars.

Each round is two map-side combined minima and two joins, whose hot keys the
adaptive planner can split. The links live in tables; nothing is gathered on
the driver. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import stored


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0xFFFFFF)))).first())


def components(links: DataFrame) -> DataFrame:
    """Node and its component's smallest node, for the nodes of ``links(u, v)``
    that are not themselves smallest.

    Nulls and links of a node with itself are ignored; repeated links count once.
    """
    e = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        now = _digest(e)
        if not now[0] or now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        e = stored(_small(_large(e)), now[0])  # a round adds no links


def least_ids(joined: DataFrame, ids: DataFrame) -> DataFrame:
    """node, root and least: of each node of ``components`` (the smallest ones
    included) the smallest id in its component. ``ids(node, id)`` names nodes;
    several may have one id."""
    inner = joined.select("node", F.col("component").alias("root"))
    nodes = inner.union(inner.select(F.col("root").alias("node"), "root").distinct())
    least = nodes.join(ids, "node").groupBy("root").agg(F.min("id").alias("least"))
    return nodes.join(least, "root").select("node", "root", "least")
