"""Explicit edges: weights of pairs of nodes, and what contraction and neighbour lists do with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesio.storage import Tables


def all_meet(x: DataFrame, y: DataFrame, x_key: str, y_key: str, x_blocks: int, y_blocks: int, tasks: int | None = None) -> DataFrame:
    """Every row of x with every row of y, as an equi-join on pairs of blocks: a task gets one block of each.

    No side is broadcast or held whole, and a row is sent once for each block it meets. ``tasks`` keeps so many from
    being put together.
    """
    block = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = x.withColumn("_bx", block(x_key, x_blocks)).withColumn("_by", every(y_blocks))
    right = y.withColumn("_by", block(y_key, y_blocks)).withColumn("_bx", every(x_blocks))
    if tasks:
        left, right = (side.repartition(tasks, "_bx", "_by") for side in (left, right))
    return left.join(right, ["_bx", "_by"]).drop("_bx", "_by")


def blocks_for(n: int, rows: int = 2048) -> int:
    """How many blocks n rows make: at least 4, so that small inputs still give 16 units."""
    return max(4, -(-n // rows))


def rounded(w: np.ndarray, places: int | None) -> np.ndarray:
    """Half away from zero, as SQL rounds; there is no negative zero."""
    if places is None:
        return w
    scale = 10.0**places
    with np.errstate(all="ignore"):
        units = np.abs(w) * scale
        if not units.max(initial=0) < 2.0**51:  # such doubles have no such places, or nothing is known of them
            return np.where(units < 2.0**51, np.copysign(np.floor(units + 0.5), w) / scale, w) + 0.0
        units += 0.5
        np.floor(units, out=units)
        units /= scale
        return np.copysign(units, w, out=units) + 0.0


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows padded with 0, their lengths) of a list column; the length is -1 where a row or one of its parts is null."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = rows.flatten(), len(rows)
    size = np.asarray(rows.value_lengths().fill_null(-1)).astype(np.int64)
    width = max(0, int(size.max(initial=0)))
    x = np.zeros((n, width))
    held = np.arange(width)[None, :] < size[:, None]
    x[held] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        gone = np.zeros((n, width), dtype=bool)
        gone[held] = flat.is_null().to_numpy(zero_copy_only=False)
        size = np.where(gone.any(axis=1), -1, size)
    return x, size


#: What becomes of a strip of a unit: ids and clusters of its rows and columns (the latter None without labels), w, which
#: places are pairs (None: all), which of their weights are null (None: none).
Give = Callable[[tuple[np.ndarray, np.ndarray], tuple[pa.Array, pa.Array] | None, np.ndarray, np.ndarray | None, np.ndarray | None], pa.RecordBatch]


def over_pairs(nodes: DataFrame, offset: float, give: Give, kinds: str, places: int | None = None, block_rows: int = 1024, clusters: bool = False, strip: int = 256) -> DataFrame:
    """What ``give`` makes of all pairs a < b and their weights, by matrix products.

    Every two blocks of nodes are a unit, so that a pair is looked at once; a unit goes through strips of at most ``strip``
    rows of a block, which ascend by id as its columns do. As in SQL, w is null where a vector or one of its components is, or where lengths differ. With
    ``clusters`` the nodes have a column cluster.
    """
    blocks = blocks_for(nodes.count(), block_rows)
    block = F.pmod(F.xxhash64("node_id"), F.lit(blocks)).cast("int")
    columns = ["node_id", "features", *["cluster"] * clusters]
    own = nodes.where("node_id is not null").select(*columns, block.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    units = own.select(*columns, "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("node_id")
        ids, home, p, q = (table[c].to_numpy() for c in ("node_id", "own", "p", "q"))
        group = table["cluster"].combine_chunks() if clusters else None
        x, size = matrix(table["features"])
        one, uneven = p[0] == q[0], (size != max(0, size[0])).any()
        left = np.flatnonzero(home == p)
        right = left if one else np.flatnonzero(home == q)
        for lo in range(0, len(left) if len(right) else 0, strip):
            rows = left[lo : lo + strip]
            w = rounded(x[rows] @ x[right].T - offset, places)
            # Ids of two blocks differ; within one a pair is taken in ascending order, and equal ids are none.
            asked = ids[rows][:, None] < ids[right][None, :] if one else None
            void = (size[rows][:, None] != size[right][None, :]) | (size[rows] < 0)[:, None] if uneven else None
            yield give((ids[rows], ids[right]), (group.take(pa.array(rows)), group.take(pa.array(right))) if clusters else None, w, asked, void)

    return units.groupBy("p", "q").applyInArrow(unit, kinds)


def large_blocks(nodes: DataFrame) -> int:
    """Rows of a block where units give little: some 78 units or more, and a vector sent about 12 times at most, as long
    as blocks needn't be larger than 8192."""
    return min(8192, max(1024, -(-nodes.count() // 12)))


def _edges(ids: tuple[np.ndarray, np.ndarray], w: np.ndarray, i: np.ndarray, j: np.ndarray, void: np.ndarray | None) -> pa.RecordBatch:
    a, b = ids[0][i], ids[1][j]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(w[i, j], mask=void[i, j] if void is not None else None)], names=["a", "b", "w"])


EDGES = "a long, b long, w double"


def pair_weights(nodes: DataFrame, offset: float, places: int | None = None, block_rows: int | None = None) -> DataFrame:
    """a, b, w of all pairs a < b. It is quadratic by nature: for instances meant to have an explicit graph. Large blocks keep
    what is sent to some 12 times the nodes, narrow strips keep a batch of rows small."""

    def give(ids, _, w, asked, void):
        if asked is not None or void is not None:
            return _edges(ids, w, *np.nonzero(asked if asked is not None else np.ones(w.shape, dtype=bool)), void)
        ends = ids[0][:, None], ids[1][None, :]
        return pa.RecordBatch.from_arrays([pa.array(x.reshape(-1)) for x in (np.minimum(*ends), np.maximum(*ends), w)], names=["a", "b", "w"])

    return over_pairs(nodes, offset, give, EDGES, places, block_rows or large_blocks(nodes), strip=64)


def leading_edges(nodes: DataFrame, offset: float, k: int, places: int | None = None) -> DataFrame:
    """Of the positive edges those that may lead once the edges at any k - 1 nodes are gone; ids must be distinct.

    Such an edge is among the k first of both of its ends' (weight, then smaller neighbour), so it is among the k first of
    one end in a strip."""

    def give(ids, _, w, asked, void):
        order = np.where(np.isnan(w), np.inf, w)
        order[order <= 0] = -np.inf
        for gone in (~asked if asked is not None else None, void):
            if gone is not None:
                order[gone] = -np.inf
        if order.shape[1] > k:
            least = np.partition(order, order.shape[1] - k, axis=1)[:, [order.shape[1] - k]]
            over, level = order > least, order == least
            level &= np.cumsum(level, axis=1, dtype=np.int32) <= k - over.sum(axis=1, keepdims=True)
            keep = (over | level) & (order > 0)
        else:
            keep = order > 0
        return _edges(ids, w, *np.nonzero(keep), None)

    return over_pairs(nodes, offset, give, EDGES, places, large_blocks(nodes))


def edges_at(nodes: DataFrame, ends: list[int], offset: float, places: int | None = None) -> DataFrame:
    """a, b, w of all edges at the nodes ``ends``, whose features are few rows; an edge between two of them comes twice."""
    few = nodes.where(F.col("node_id").isin(ends)).select("node_id", "features").toArrow()
    keys, (y, lengths) = few["node_id"].to_numpy(), matrix(few["features"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (x, size) = batch["node_id"].to_numpy(), matrix(batch["features"])
            width = min(x.shape[1], y.shape[1])
            for key, v, length in zip(keys, y, lengths):
                w, void, some = rounded(x[:, :width] @ v[:width] - offset, places), (size != length) | (size < 0), ids != key
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids, key)[some]), pa.array(np.maximum(ids, key)[some]), pa.array(w[some], mask=void[some])], names=["a", "b", "w"])

    return nodes.where("node_id is not null").select("node_id", "features").mapInArrow(found, EDGES)


def weights_over(nodes: DataFrame, offset: float, places: int | None = None, zero: bool = False) -> DataFrame:
    """positive(pair_weights(...)), or non_negative where ``zero``; the others don't leave the products' task."""

    def give(ids, _, w, asked, void):
        over = ~(w < 0 if zero else w <= 0)  # NaN is the largest, as in SQL
        for part in (asked, ~void if void is not None else None):
            if part is not None:
                over &= part
        return _edges(ids, w, *np.nonzero(over), None)

    return over_pairs(nodes, offset, give, EDGES, places, large_blocks(nodes))


def best_pair(nodes: DataFrame, offset: float, places: int | None = None) -> DataFrame:
    """best_edge(pair_weights(...)): each strip gives its best edge, and the best of these is the best of all."""

    def give(ids, _, w, asked, void):
        order = np.where(np.isnan(w), np.inf, w)  # NaN goes before all, null behind all
        if void is not None:
            order[void] = -np.inf
        if asked is not None:
            there = asked & (order == order[asked].max(initial=-np.inf))
        else:
            there = order == order.max()
        found = _edges(ids, w, *np.nonzero(there), void)
        # Of equal ones, among which may be NaN or null, the first as SQL orders them.
        rank = pa.array(np.where(np.asarray(found["w"].is_null()), 2, np.where(np.isnan(found["w"].fill_null(0.0).to_numpy(zero_copy_only=False)), 0, 1)))
        return pa.RecordBatch.from_arrays([*found.columns, rank], names=["a", "b", "w", "r"]).sort_by([("r", "ascending"), ("a", "ascending"), ("b", "ascending")]).slice(0, 1).select(["a", "b", "w"])

    return best_edge(over_pairs(nodes, offset, give, EDGES, places, large_blocks(nodes)))


def cluster_edges(nodes: DataFrame, labels: DataFrame, offset: float, places: int | None = None) -> DataFrame:
    """contract_edges(pair_weights(...), labels): each strip's pairs are summed by their clusters where they are weighed."""

    def give(_, groups, w, asked, void):
        pairs = np.ones(w.shape, dtype=bool) if asked is None else asked
        held = pairs if void is None else pairs & ~void
        w[~held] = 0.0
        codes = [g.dictionary_encode() for g in groups]
        some = [np.asarray(c.indices.fill_null(-1)) for c in codes]
        order = [np.argsort(c, kind="stable") for c in some]
        start = [np.flatnonzero(np.diff(c[o], prepend=-2)) for c, o in zip(some, order)]

        def summed(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(np.add.reduceat(x[order[0]][:, order[1]], start[0], axis=0), start[1], axis=1)

        total, n, n_held = summed(w), summed(pairs.astype(np.int64)), summed(held.astype(np.int64))
        i, j = np.nonzero(n)
        # The places of clusters; a node without one (-1) takes no part.
        at = [c[o][s] for c, o, s in zip(some, order, start)]
        fine = (at[0][i] >= 0) & (at[1][j] >= 0)
        i, j = i[fine], j[fine]
        a, b = (np.asarray(c.dictionary)[k] for c, k in zip(codes, (at[0][i], at[1][j])))
        fine = a != b
        i, j, a, b = i[fine], j[fine], a[fine], b[fine]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(total[i, j], mask=n_held[i, j] == 0)], names=["a", "b", "w"])

    own = nodes.join(labels.select("node_id", F.col("cluster").cast("long").alias("cluster")), "node_id")
    w = F.sum("w")
    return over_pairs(own, offset, give, EDGES, None, large_blocks(own), True).groupBy("a", "b").agg((F.round(w, places) if places is not None else w).alias("w"))


def cut_cost(nodes: DataFrame, labels: DataFrame, offset: float) -> DataFrame:
    """cost: the weights of all pairs in two clusters; each strip gives one sum."""

    def give(_, groups, w, asked, void):
        one, two = (np.asarray(g.fill_null(0)) for g in groups)
        gone, other = (np.asarray(g.is_null()) for g in groups)
        none = (one[:, None] == two[None, :]) | gone[:, None] | other[None, :]
        if asked is not None:
            none |= ~asked
        if void is not None:
            none |= void
        w[none] = 0.0
        return pa.RecordBatch.from_arrays([pa.array([float(w.sum())])], names=["w"])

    own = nodes.join(labels.select("node_id", F.col("cluster").cast("long").alias("cluster")), "node_id")
    return over_pairs(own, offset, give, "w double", None, large_blocks(own), True).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("cost"))


def positive(edges: DataFrame) -> DataFrame:
    """Edges that may be contracted: of weight strictly over 0."""
    return edges.where("w > 0")


def non_negative(edges: DataFrame) -> DataFrame:
    """Edges that a neighbour list admits."""
    return edges.where("w >= 0")


def contract_edges(edges: DataFrame, labels: DataFrame, places: int | None = None) -> DataFrame:
    """Edges between clusters: ends relabelled (node_id, cluster), parallel edges' weights summed."""
    ends = [labels.select(F.col("node_id").alias(e), F.col("cluster").alias(f"cluster_{e}")) for e in "ab"]
    both = edges.join(ends[0], "a").join(ends[1], "b").where("cluster_a <> cluster_b")
    w = F.sum("w")
    return both.groupBy(F.least("cluster_a", "cluster_b").alias("a"), F.greatest("cluster_a", "cluster_b").alias("b")).agg((F.round(w, places) if places is not None else w).alias("w"))


def best_edge(edges: DataFrame) -> DataFrame:
    """The edge of largest weight; ties to the smaller ends."""
    return edges.orderBy(F.desc("w"), "a", "b").limit(1)


def directed(edges: DataFrame) -> DataFrame:
    """i, j, w in both directions."""
    return edges.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").unionByName(edges.select(F.col("b").alias("i"), F.col("a").alias("j"), "w"))


def best_by_node(edges: DataFrame) -> DataFrame:
    """Each node's best neighbour (i, j, w); ties to the smaller neighbour."""
    best = F.max(F.struct("w", (-F.col("j")).alias("j")))
    return directed(edges).groupBy("i").agg(best.alias("m")).select("i", (-F.col("m.j")).alias("j"), F.col("m.w").alias("w"))


def least_weight(lists: DataFrame) -> DataFrame:
    """The least weight in each node's neighbour list (i, j, w)."""
    return lists.groupBy("i").agg(F.min("w").alias("min_w"))


def common_neighbours(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """x, y, j, w: for each pair asked (x, y) the neighbours in both lists, with the weight they have to the union."""
    one = asked.join(lists.select(F.col("i").alias("x"), "j", "w"), "x")
    two = lists.select(F.col("i").alias("y"), "j", F.col("w").alias("w2"))
    return one.join(two, ["y", "j"]).select("x", "y", "j", (F.col("w") + F.col("w2")).alias("w"))


def exclusive_neighbours(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """x, y, i, j, w: for each pair asked the neighbours j, neither x nor y, in one of the two lists only, and whose (i)."""
    own = asked.select("x", "y", F.explode(F.array("x", "y")).alias("i")).join(lists.select("i", "j", "w"), "i")
    outside = own.where((F.col("j") != F.col("x")) & (F.col("j") != F.col("y")))
    return outside.groupBy("x", "y", "j").agg(F.count("*").alias("n"), F.min("i").alias("i"), F.min("w").alias("w")).where("n = 1").select("x", "y", "i", "j", "w")


def inverse_neighbours(lists: DataFrame) -> DataFrame:
    """How many lists each node is in, and the largest weight it has there."""
    return lists.groupBy(F.col("j").alias("node_id")).agg(F.count("*").alias("followers"), F.max("w").alias("max_w"))


def contiguous(labels: DataFrame, store: Tables) -> DataFrame:
    """Labels 0 .. c-1 in the order of cluster ids: ranks of the distinct ids, found in as many tasks as ids need."""
    ids = labels.select("cluster").distinct().repartitionByRange("cluster").withColumn("part", F.spark_partition_id())
    parted = store(ids, "ids")
    sizes = {r["part"]: r["count"] for r in parted.groupBy("part").count().collect()}  # a row for each partition
    before, starts = 0, []
    for k in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(k, 0)
    start = F.element_at(F.split(F.lit(",".join(map(str, starts)) or "0"), ",").cast("array<bigint>"), F.col("part") + 1)
    rank = F.row_number().over(Window.partitionBy("part").orderBy("cluster")) - 1 + start
    return labels.join(parted.select("cluster", rank.cast("long").alias("label")), "cluster").select("node_id", "label")
