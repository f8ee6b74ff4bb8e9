"""The multicut objective: sums of affinities of cut pairs, in closed form and literally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesio.functions.vectors import weight
from cohesio.operators.pairs import all_meet, blocks_for, cut_cost


def group_weights(nodes: DataFrame, offset: float, by: list[str]) -> DataFrame:
    """For each group of nodes (features) the sum of weights of all its pairs, as ``inside``, without pairs.

    By group, sum of w(i, j) over i < j = (|sum f|^2 - sum |f|^2) / 2 - offset * n (n - 1) / 2.
    """
    each = nodes.select(*by, F.posexplode("features").alias("_at", "_x"))
    dims = each.groupBy(*by, "_at").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.sum(F.col("_x").cast("double") * F.col("_x").cast("double")).alias("_q"), F.count("*").alias("_n"))
    n = F.max("_n")
    return dims.groupBy(*by).agg((F.sum(F.col("_s") * F.col("_s") - F.col("_q")) / 2 - offset * n * (n - 1) / 2).alias("inside"), n.alias("size"))


def all_cut_cost(nodes: DataFrame, offset: float) -> DataFrame:
    """cost: the objective when every node is a cluster of its own."""
    return group_weights(nodes, offset, []).select(F.coalesce("inside", F.lit(0.0)).alias("cost"))


def labeling_cost(nodes: DataFrame, labels: DataFrame, offset: float) -> DataFrame:
    """cost of a labeling (node_id, cluster): all pairs' weight less that within clusters; linear in the data."""
    own = nodes.join(labels, "node_id")
    total = group_weights(own, offset, []).select(F.coalesce("inside", F.lit(0.0)).alias("x"))
    inside = group_weights(own, offset, ["cluster"]).select((-F.col("inside")).alias("x"))
    return total.unionByName(inside).agg(F.sum("x").alias("cost"))


def labeling_cost_by_pairs(nodes: DataFrame, labels: DataFrame, offset: float) -> DataFrame:
    """cost by its definition over all pairs; quadratic, for checks on small instances."""
    return cut_cost(nodes, labels, offset)


def cluster_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.countDistinct("cluster").alias("clusters"))


def cluster_pair_weights(clusters: DataFrame, offset: float) -> DataFrame:
    """a, b, w of all pairs of clusters, from their sums alone."""
    x, y = (clusters.select(F.col("cluster").alias(e), F.col("size").alias(f"size_{e}"), F.col("fsum").alias(f"fsum_{e}")) for e in "ab")
    blocks = blocks_for(clusters.count())
    return all_meet(x, y, "a", "b", blocks, blocks).where("a < b").select("a", "b", weight("fsum_a", "fsum_b", offset, "size_a", "size_b").alias("w"))
