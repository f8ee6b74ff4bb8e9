"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

Bins are ordered by the room left. A document takes the tightest bin that has room and no conflict: the
search starts at the first bin with enough room and goes on to its successors until one is compatible, else
a new bin is opened. Each bin carries a bitmap of its sources and one of its duplicate clusters; a bin never
holds two documents of one source nor two of one cluster. A shard takes its documents longest first.

Shards are by hash of what packing reads (doc_id, length, source, cluster), about ``shard_rows`` documents each,
and are packed on their own: memory is bounded, a source, cluster or doc_id with a third of all rows is spread
over all shards, and each bin's contents depend on the shard alone. Rows alike in all four are counted before
anything is moved and dealt out in portions, so even they make no large shard. A document longer than a bin fills
bins of its own and its rest is packed.

Cases: a null or negative length counts as 0, and so takes no room, but has a place; null sources and
clusters conflict with nothing; repeated rows are packed each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows alike in all that is read are dealt out in portions of so many.
PORTION = 64


def pack(items: list[tuple[int, int | None, int | None]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) from items of (length, source, cluster), in the order given."""
    bits: dict[tuple[str, int], int] = {}
    mask = lambda kind, value: 0 if value is None else 1 << bits.setdefault((kind, value), len(bits))
    bins: list[list[tuple[int, int, int]]] = []
    carried: list[list[int]] = []  # of each bin: its bitmaps of sources and clusters
    order: list[tuple[int, int]] = []  # (room, bin)
    for item, (length, source, cluster) in enumerate(items):
        start = 0
        while length - start > capacity:
            bins.append([(item, start, capacity)])
            carried.append([0, 0])
            start += capacity
        rest, s, c = length - start, mask("s", source), mask("c", cluster)
        at = bisect_left(order, (rest, -1))
        while at < len(order) and (carried[order[at][1]][0] & s or carried[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            room, k = order.pop(at)
        else:
            room, k = capacity, len(bins)
            bins.append([])
            carried.append([0, 0])
        bins[k].append((item, start, rest))
        carried[k][0] |= s
        carried[k][1] |= c
        if room > rest:
            insort(order, (room - rest, k))
    return bins


def packed(docs: DataFrame, length: Column, cluster: Column, capacity: int = 8192, shard_rows: int = 4096) -> DataFrame:
    """doc_id, bin_id, place, start, length, source: a row for each document or piece of one.

    docs has doc_id and source; length is in the units of capacity. Bin ids are unique: the shard's number
    times 2^24 and the bin's number in it.
    """
    rows = docs.select("doc_id", F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("length"), "source", cluster.cast("long").alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    alike = rows.groupBy("doc_id", "length", "source", "cluster").agg(F.count("*").alias("n"))
    portions = alike.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PORTION))))
    portions = portions.withColumn("n", F.least(F.lit(PORTION), F.col("n") - F.col("portion") * PORTION))
    key = F.xxhash64("doc_id", "length", F.col("source").isNull(), "source", "cluster", "portion")
    dealt = portions.select(F.pmod(key, F.lit(shards)).alias("shard"), "doc_id", "length", "source", F.xxhash64("source").alias("s"), "cluster", "n")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        table = table.take(np.repeat(np.arange(table.num_rows), table["n"].to_numpy()))
        ids, sources, shard = table["doc_id"].to_pylist(), table["source"].to_pylist(), table["shard"][0].as_py() if len(table) else 0
        items = [(n, None if of is None else s, c) for n, s, of, c in zip(*(table[x].to_pylist() for x in ("length", "s", "source", "cluster")))]
        out = [(ids[item], (shard << 24) + k, place, start, n, sources[item]) for k, found in enumerate(pack(items, capacity)) for place, (item, start, n) in enumerate(found)]
        columns = list(zip(*out)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.table({n: pa.array(c, type=t) for n, c, t in zip(("doc_id", "bin_id", "place", "start", "length", "source"), columns, kinds)})

    return dealt.groupBy("shard").applyInArrow(one, "doc_id long, bin_id long, place int, start long, length long, source string")
