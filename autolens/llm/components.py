"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

MAX_ROUNDS = 60


def _lowest(edges: DataFrame) -> DataFrame:
    """The lowest neighbour of each node, the node itself included."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every higher neighbour of a node is linked to the node's lowest neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        .where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are linked to the lowest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = down.join(_lowest(down), "u")
    return (
        linked.select("u", F.col("low").alias("v"))
        .unionAll(linked.select(F.col("v").alias("u"), F.col("low").alias("v")))
        .where("u <> v").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for the nodes of the links `(u, v)` that reach a lower one; root is the
    lowest they reach, and has no row itself.

    Rounds of large and small stars until nothing changes; each is written to the
    shared folder. Only a count and a checksum of the links come to the driver.
    """
    current = Stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        after = Stage(_small_star(_large_star(current.read())))
        found = after.read().agg(
            F.count(F.lit(1)), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0L)")
        ).first()
        current.drop()
        current = after
        if found == mark:
            return current.read().select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = found
    raise RuntimeError(f"components: not settled after {MAX_ROUNDS} rounds")
