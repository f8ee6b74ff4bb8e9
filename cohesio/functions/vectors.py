"""Column expressions on feature vectors (arrays), all in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner(x: Column | str, y: Column | str) -> Column:
    """The inner product of two arrays."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def weight(x, y, offset: float, size_x=1, size_y=1) -> Column:
    """Affinity of two clusters given sums of features and sizes: <x, y> - offset * size_x * size_y."""
    sizes = [F.col(c) if isinstance(c, str) else F.lit(c) for c in (size_x, size_y)]
    return inner(x, y) - F.lit(float(offset)) * sizes[0] * sizes[1]


def with_offset(x: Column | str, offset: float) -> Column:
    """The vector with sqrt(offset) appended; the last dimension of such vectors counts negatively."""
    if offset < 0:
        raise ValueError("the offset must not be negative")
    return F.concat(F.transform(x, lambda v: v.cast("double")), F.array(F.lit(math.sqrt(offset))))


def signed_inner(x: Column | str, y: Column | str, tracked: bool) -> Column:
    """The inner product where, if tracked, the last dimension is subtracted."""
    whole = inner(x, y)
    if not tracked:
        return whole
    last = F.element_at(x, -1).cast("double") * F.element_at(y, -1).cast("double")
    return whole - 2 * last


def vector_sums(df: DataFrame, key: str, vector: str, size: Column | None = None) -> DataFrame:
    """(key, size, fsum): sums by key, partial on the map side, however large a group is."""
    each = df.select(key, (size if size is not None else F.lit(1)).cast("long").alias("_n"), F.posexplode(vector).alias("_at", "_x"))
    sums = each.groupBy(key, "_at").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.sum("_n").alias("_n"))
    rows = F.array_sort(F.collect_list(F.struct("_at", "_s")))  # one entry for each dimension
    return sums.groupBy(key).agg(F.max("_n").alias("size"), F.transform(rows, lambda r: r["_s"]).alias("fsum"))
