"""Contraction: clusters that are matched become one, under the smaller id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesio.functions.vectors import vector_sums


def relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """labels (node_id, cluster) after b joins a for each row of merged; a matching is disjoint, so one step is enough."""
    return labels.join(merged.select(F.col("b").alias("cluster"), F.col("a").alias("_to")), "cluster", "left").select("node_id", F.coalesce("_to", "cluster").alias("cluster"))


def contracted(clusters: DataFrame, merged: DataFrame) -> DataFrame:
    """clusters (cluster, size, fsum) after the merges: sizes and vectors of both sides are added."""
    others = clusters.select(F.col("cluster").alias("b"), F.col("size").alias("_size"), F.col("fsum").alias("_fsum")).join(merged.select("a", "b"), "b").select(F.col("a").alias("cluster"), "_size", "_fsum")
    left = clusters.join(merged.select(F.col("b").alias("cluster")), "cluster", "left_anti").join(others, "cluster", "left")
    added = F.when(F.col("_fsum").isNotNull(), F.zip_with("fsum", "_fsum", lambda x, y: x + y)).otherwise(F.col("fsum"))
    return left.select("cluster", (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"), added.alias("fsum"))


def sums_of(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """clusters (cluster, size, fsum) of a labeling."""
    return vector_sums(nodes.join(labels, "node_id"), "cluster", "features")


def canonical(labels: DataFrame) -> DataFrame:
    """Each cluster named by its smallest node id."""
    names = labels.groupBy("cluster").agg(F.min("node_id").alias("_name"))
    return labels.join(names, "cluster").select("node_id", F.col("_name").alias("cluster"))


def connected(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of nodes with same: whether both are in one cluster."""
    ends = [labels.select(F.col("node_id").alias(e), F.col("cluster").alias(f"_{e}")) for e in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").withColumn("same", F.col("_a") == F.col("_b")).drop("_a", "_b")
