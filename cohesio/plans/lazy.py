"""Lazy contraction: only edges of a k-nearest-neighbour graph are contracted, and the graph is built anew over
the clusters when none of its edges is positive any more. It ends when a new graph has no positive edge, which
with an exact index means that no pair of clusters has.

Within a graph all edges that are the best at both of their ends (ties to the smaller neighbour) are contracted at
once, the others are taken over to the unions and weighed anew from the clusters' sums, and those stay that are
positive and among the best ``cap`` at one of their ends; and so on. The best edge of all is among those contracted, so
this comes close to contracting one best edge after another, in few steps. The rule is the same at every size: a small
number of clusters goes through the same steps within one task, with the same labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesio.functions.vectors import weight
from cohesio.operators import contraction, matching, neighbours, pairs
from cohesio.plans.rounds import Solution
from cohesio.sources.problem import Problem
from cohesio.storage import keeper

#: Positions a < b and weights of a graph's edges, each pair once.
Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def nearest_here(size: np.ndarray, x: np.ndarray, k: int, offset: float, places: int) -> Edges:
    """Positive edges of the k-nearest-neighbour graph of clusters in memory."""
    found = []
    for lo in range(0, len(x), 512):
        w = np.round(x[lo : lo + 512] @ x.T - offset * size[lo : lo + 512, None] * size[None, :], places)
        w[np.arange(len(w)), np.arange(lo, lo + len(w))] = -np.inf
        i, j = np.nonzero((w >= np.partition(w, len(x) - k, axis=1)[:, [len(x) - k]]) & (w > 0))
        v = w[i, j]
        order = np.lexsort((j, -v, i))
        i, j, v = i[order], j[order], v[order]
        fine = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[fine] + lo, j[fine], v[fine]))
    i, j, v = (np.concatenate(c) for c in zip(*found))
    pair, at = np.unique(np.minimum(i, j) * len(x) + np.maximum(i, j), return_index=True)
    return pair // len(x), pair % len(x), v[at]


def ranked_here(edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """For each edge its place, from 0, among the edges at either of its ends: by weight, ties to the smaller neighbour."""
    a, b, w = edges
    i, j = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((j, -np.concatenate([w, w]), i))
    own = i[order]
    place = np.empty(len(i), dtype=np.int64)
    place[order] = np.arange(len(i)) - np.searchsorted(own, own)
    return place[: len(a)], place[len(a) :]


def contract_here(size: np.ndarray, x: np.ndarray, edges: Edges, offset: float, cap: int, places: int) -> np.ndarray:
    """The cluster of each position after all contractions within a graph in memory; size and x are added up in place."""
    to, n = np.arange(len(x)), len(x)
    while len(edges[0]):
        at_a, at_b = ranked_here(edges)
        best = (at_a == 0) & (at_b == 0)
        a, b = edges[0][best], edges[1][best]
        size[a] += size[b]
        x[a] += x[b]
        step = np.arange(n)
        step[b] = a
        to = step[to]
        p, q = step[edges[0]], step[edges[1]]
        pair = np.unique((np.minimum(p, q) * n + np.maximum(p, q))[p != q])
        a, b = pair // n, pair % n
        w = np.round(np.einsum("ij,ij->i", x[a], x[b]) - offset * size[a] * size[b], places)
        over = w > 0
        edges = a[over], b[over], w[over]
        at_a, at_b = ranked_here(edges)
        kept = (at_a < cap) | (at_b < cap)
        edges = tuple(c[kept] for c in edges)
    return to


def finish(clusters: DataFrame, k: int, cap: int, offset: float, places: int) -> DataFrame:
    """cluster, to, rounds: all further graphs and contractions in one task; for a checked, small number of clusters."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("cluster")
        ids, size, x = neighbours._matrix(table)
        size, x, final, now, counts = size.copy(), x.copy(), np.arange(len(ids)), np.arange(len(ids)), []
        while len(now) > 1:
            edges = nearest_here(size[now], x[now], min(k, len(now) - 1), offset, places)
            if not len(edges[0]):
                break
            sizes, sums = size[now], x[now]
            to = contract_here(sizes, sums, edges, offset, cap, places)
            size[now], x[now] = sizes, sums
            whole = np.arange(len(ids))
            whole[now] = now[to]
            final = whole[final]
            counts.append(int((to != np.arange(len(now))).sum()))
            now = now[to == np.arange(len(now))]
        return pa.table({"cluster": table["cluster"], "to": pa.array(ids[final]), "rounds": pa.array([counts] * len(ids), type=pa.list_(pa.int64()))})

    return clusters.select("cluster", "size", "fsum").groupBy(F.lit("all").alias("_all")).applyInArrow(one, "cluster long, to long, rounds array<long>")


def contracted_in_task(clusters: DataFrame, graph: DataFrame, offset: float, cap: int, places: int) -> DataFrame:
    """cluster, to, size, fsum: the clusters after all contractions within a graph, in one task; for few edges and
    the clusters at their ends."""

    def one(vectors: pa.Table, edges: pa.Table) -> pa.Table:
        ids, size, x = neighbours._matrix(vectors.sort_by("cluster"))
        size, x = size.copy(), x.copy()
        a, b = (np.searchsorted(ids, edges[c].to_numpy()) for c in ("a", "b"))
        to = contract_here(size, x, (a, b, edges["w"].to_numpy()), offset, cap, places)
        sums = pa.array([v.tolist() for v in x], type=pa.list_(pa.float64()))
        return pa.table({"cluster": pa.array(ids), "to": pa.array(ids[to]), "size": pa.array(size.astype(np.int64)), "fsum": sums})

    key = F.lit("all").alias("_all")
    return clusters.select("cluster", "size", "fsum").groupBy(key).cogroup(graph.select("a", "b", "w").groupBy(key)).applyInArrow(one, "cluster long, to long, size long, fsum array<double>")


def ranked(edges: DataFrame, cap: int | None = None) -> DataFrame:
    """a, b, w, best: each edge once, and whether it is the best at both of its ends; with ``cap`` those alone that are
    among the best ``cap`` at one of them. Rows may repeat an edge, with one weight."""
    by = Window.partitionBy("i").orderBy(F.desc("w"), "j")
    # Repeated rows share a rank, so that a rank counts neighbours.
    placed = pairs.directed(edges).withColumn("r", F.dense_rank().over(by))
    placed = placed if cap is None else placed.where(F.col("r") <= cap)
    first = lambda end: F.max((F.col("r") == 1) & (F.col("i") == F.col(end)))
    return placed.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "i", "w", "r").groupBy("a", "b").agg(F.max("w").alias("w"), (first("a") & first("b")).alias("best"))


def merged(clusters: DataFrame, graph: DataFrame) -> DataFrame:
    """cluster, size, fsum, of: the clusters after b joins a for each best edge of a graph; ``of`` are those that each was."""
    to = graph.where("best").select(F.col("b").alias("cluster"), F.col("a").alias("_to"))
    parts = clusters.select("cluster", "size", "fsum").join(to, "cluster", "left")
    both = F.collect_list(F.struct("cluster", "size", "fsum"))  # two at most, as best edges are a matching
    found = parts.groupBy(F.coalesce("_to", "cluster").alias("to")).agg(F.array_sort(both).alias("p"))
    x, y = F.col("p")[0], F.get(F.col("p"), F.lit(1))
    one = F.size("p") == 1
    added = F.when(one, x["fsum"]).otherwise(F.zip_with(x["fsum"], y["fsum"], lambda u, v: u + v))
    return found.select(F.col("to").alias("cluster"), (x["size"] + F.coalesce(y["size"], F.lit(0))).alias("size"), added.alias("fsum"), F.col("p.cluster").alias("of"))


def taken_over(graph: DataFrame, clusters: DataFrame, offset: float, places: int) -> DataFrame:
    """a, b, w: the edges of a graph between what merged returns, weighed anew where an end is a union; rows may repeat one."""
    ends = [clusters.select(F.explode("of").alias(e), F.col("cluster").alias(f"to_{e}"), F.col("size").alias(f"size_{e}"), F.col("fsum").alias(f"fsum_{e}"), (F.size("of") > 1).alias(f"new_{e}")) for e in "ab"]
    met = graph.select("a", "b", "w").join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b")
    # The sizes in the order of the ends, so that both rows of a repeated edge have one weight.
    turned = F.col("to_a") > F.col("to_b")
    met = met.withColumns({"_p": F.when(turned, F.col("size_b")).otherwise(F.col("size_a")), "_q": F.when(turned, F.col("size_a")).otherwise(F.col("size_b"))})
    w = F.when(F.col("new_a") | F.col("new_b"), F.round(weight("fsum_a", "fsum_b", offset, "_p", "_q"), places)).otherwise(F.col("w"))
    return met.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"), w.alias("w"))


#: A graph that is down to so many edges is contracted to its end by one task; labels are stored after so many steps.
FEW_EDGES, STEPS_KEPT = 20_480, 8


def dense_laec(problem: Problem, k: int = 5, cap: int = 5, index: str | neighbours.Index = "brute_force", later: str | neighbours.Index | None = None, small_nodes: int = 4096, places: int = 9, most_rounds: int = 10_000, small_edges: int = FEW_EDGES) -> Solution:
    """Lazy contraction; ``later`` is the index from the second graph on. Once at most ``small_nodes`` clusters are left
    and the index is exact, one task does all the rest by the same rule. Weights are rounded to ``places``.

    Where a cluster grows by its neighbours one at a time, a graph has hundreds of steps with few edges: from ``small_edges``
    on, one task does its remaining steps. It gets those edges and the clusters at their ends alone, whatever their number
    in all. A distributed step stores two tables: the clusters that its best edges made, with the names of their parts,
    and the graph between these, which tells the next best edges."""
    keep = keeper(problem.nodes.sparkSession, "lazy")
    first, then = (neighbours.parse_index(x) if isinstance(x, str) else x for x in (index, later or index))
    clusters, labels, rounds = keep(problem.clusters(), "clusters-0"), problem.nodes.select("node_id", F.col("node_id").alias("cluster")), []
    n = clusters.count()
    for build in range(1, most_rounds + 1):
        if n < 2:
            break
        if n <= small_nodes and (first if build == 1 else then).exact:
            last = keep(finish(clusters, k, cap, problem.offset, places), "last")
            moved = last.where("to <> cluster").select(F.col("to").alias("a"), F.col("cluster").alias("b"))
            return Solution(problem, contraction.relabelled(labels, moved), rounds + list(last.select("rounds").first()["rounds"]))
        near = neighbours.nearest(clusters, min(k, n - 1), problem.offset, first if build == 1 else then, places=places, n=(n, n))
        graph, step = keep(ranked(matching.candidates(near.withColumn("w", F.round("w", places)))), f"graph-{build}"), 0
        before = n
        while (edges := graph.count()) > small_edges:
            step += 1
            tag = f"{build}-{step}"
            labels = contraction.relabelled(labels, graph.where("best").select("a", "b"))
            labels = keep(labels, f"labels-{tag}") if step % STEPS_KEPT == 0 else labels
            clusters = keep(merged(clusters, graph), f"merged-{tag}")
            graph = keep(ranked(pairs.positive(taken_over(graph, clusters, problem.offset, places)), cap), f"graph-{tag}")
        clusters = clusters.select("cluster", "size", "fsum")
        if edges:
            ends = graph.select(F.explode(F.array("a", "b")).alias("cluster")).distinct()
            done = keep(contracted_in_task(clusters.join(ends, "cluster", "left_semi"), graph, problem.offset, cap, places), f"done-{build}")
            labels = contraction.relabelled(labels, done.where("cluster <> to").select(F.col("to").alias("a"), F.col("cluster").alias("b")))
            clusters = keep(clusters.join(ends, "cluster", "left_anti").unionByName(done.where("cluster = to").drop("to")), f"clusters-{build}")
        labels = keep(labels, f"labels-{build}")
        n = clusters.count()
        if n == before:
            break
        rounds.append(before - n)
    return Solution(problem, labels, rounds)
