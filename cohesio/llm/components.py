"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 4


def connected(edges: DataFrame, store: Callable[[DataFrame, str], DataFrame], tag: str) -> DataFrame:
    """(node, root) of every node of an edge (u, v) of longs; root is the least node of its component.

    Each round halves distances at least; rounds go on until the edges are stars around the roots: no node has
    two edges to smaller ones, or one and a larger neighbour too. Every round is a table under the shared folder. Loops
    and null ends are left out.
    """
    now = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-0")
    step = 0
    salt, salts = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    while not _stars(now):
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A hub's edges are joined to its least neighbour under SALTS keys, so no task gets all of
        # them; by merge, as both sides grow with the edges.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), salts)
        large = both.withColumn("salt", salt).join(least.hint("merge"), ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select("u", "m", salts)
        small = large.withColumn("salt", salt).join(low.hint("merge"), ["u", "salt"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = store(small, f"{tag}-{step}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    up = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = up.unionByName(down).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()
