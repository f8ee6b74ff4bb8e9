"""Shards of a table in the order of a key, by cut points that follow from the table alone.

A range sort's own cut points are sampled and so change with the partitioning. Here keys' weights are added up
exactly in the order of the keys, and a shard begins wherever another ``size`` of weight is full. Keys are
counted per key first; what comes to the driver is a sum for each partition and a cut for each shard, of which
there are at most about ``most``: shards grow with the table beyond that. A key heavier than a shard is shared
out by a hash to several units of its own shard; null keys have a shard at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohesio.storage import Tables


def _array(values: list[int]) -> Column:
    """An array literal, folded once, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


@dataclass(frozen=True)
class Cuts:
    """starts: the least key of each shard; parts: the units of each, that of null keys last."""

    starts: list[int]
    parts: list[int]

    def shard(self, key: Column) -> Column:
        """The number of the key's shard, by binary search."""
        n = len(self.starts)
        if not n:
            return F.lit(0)
        all_starts = _array(self.starts)
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
        at = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= n) & (F.element_at(all_starts, F.least(lo + s, F.lit(n))) <= key), lo + s).otherwise(lo))
        return F.when(key.isNull(), n).otherwise(F.greatest(at - 1, F.lit(0))).cast("int")

    def unit(self, key: Column, spread: Column) -> Column:
        """The number of the row's unit, in the order of the keys; ``spread`` shares out a heavy key's rows."""
        before = _running(self.parts)
        shard = self.shard(key)
        return (F.element_at(_array(before), shard + 1) + F.pmod(spread, F.element_at(_array(self.parts), shard + 1))).cast("int")

    @property
    def units(self) -> int:
        return sum(self.parts)


def _running(parts: list[int]) -> list[int]:
    out, at = [], 0
    for p in parts:
        out.append(at)
        at += p
    return out


def cut(weights: DataFrame, store: Tables, tag: str, size: int, most: int = 65_536) -> Cuts:
    """The cuts of a table by (key long, weight long), one row or more for each of its rows."""
    known = weights.where("key is not null").groupBy("key").agg(F.sum("weight").alias("weight"))
    ranged = store(known.repartitionByRange("key").withColumn("part", F.spark_partition_id()), f"{tag}-keys")
    sums = {r["part"]: r["weight"] for r in ranged.groupBy("part").agg(F.sum("weight").alias("weight")).collect()}
    null = weights.where("key is null").agg(F.sum("weight").alias("weight")).first()["weight"] or 0
    size = max(size, -(-(sum(sums.values()) + null) // most))
    offsets, at = [], 0
    for k in range(max(sums, default=-1) + 1):
        offsets.append(at)
        at += sums.get(k, 0)
    rows = []
    if sums:
        within = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("weight").over(within), F.lit(0)) + F.element_at(_array(offsets), F.col("part") + 1)
        placed = ranged.select("key", "weight", F.floor(before / F.lit(float(size))).alias("shard"))
        rows = placed.groupBy("shard").agg(F.min("key").alias("key"), F.max("weight").alias("most")).orderBy("shard").collect()
    store.drop(f"{tag}-keys")
    return Cuts([r["key"] for r in rows], [max(1, r["most"] // size) for r in rows] + [max(1, -(-null // size))])


def dealt(df: DataFrame, cuts: Cuts, key: Column, spread: Column, *order: Column) -> DataFrame:
    """df with its column ``unit``, each unit a partition of its own (or one of many in a partition), in order."""
    units = df.withColumn("unit", cuts.unit(key, spread))
    return units.repartitionById(cuts.units, "unit").sortWithinPartitions("unit", *order)
