"""Greedy maximum-weight matching: by weight, ties to smaller ends, each edge is taken if both ends are free."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesio.operators.pairs import best_by_node

Store = Callable[[DataFrame, str], DataFrame]


def match_here(edges: list[tuple[float, int, int]]) -> list[tuple[int, int, float]]:
    """The greedy matching of edges (w, a, b) in memory."""
    taken: set[int] = set()
    out = []
    for w, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if a not in taken and b not in taken:
            taken |= {a, b}
            out.append((a, b, w))
    return out


def greedy_matching(edges: DataFrame, store: Store, tag: str, small: int = 50_000) -> DataFrame:
    """a, b, w of the greedy matching of edges a < b.

    An edge that is the best at both of its ends is in the greedy matching; it is taken, edges at its ends go,
    and so on. In a chain of falling weights a round takes one edge only, so once at most ``small`` edges are
    left one task takes the rest.
    """
    # The order must be strict: best_by_node breaks ties by the neighbour, the order of edges by (a, b).
    taken, left, step = None, store(edges.select("a", "b", "w").distinct(), f"{tag}-edges"), 0
    while (n := left.count()) > small:
        step += 1
        first = F.max(F.struct("w", (-F.col("a")).alias("a"), (-F.col("b")).alias("b")))
        ends = left.select(F.explode(F.array("a", "b")).alias("i"), "a", "b", "w").groupBy("i").agg(first.alias("m"))
        both = ends.groupBy((-F.col("m.a")).alias("a"), (-F.col("m.b")).alias("b"), F.col("m.w").alias("w")).agg(F.count("*").alias("ends")).where("ends = 2").drop("ends")
        new = store(both, f"{tag}-taken-{step}")
        taken = new if taken is None else taken.unionByName(new)
        gone = new.select(F.explode(F.array("a", "b")).alias("x"))
        left = store(left.join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti"), f"{tag}-left-{step}")

    def rest(table: pa.Table) -> pa.Table:
        found = list(zip(*match_here(list(zip(*(table[c].to_pylist() for c in ("w", "a", "b"))))))) or [[], [], []]
        return pa.table({"a": pa.array(found[0], type=pa.int64()), "b": pa.array(found[1], type=pa.int64()), "w": pa.array(found[2], type=pa.float64())})

    if n:
        last = left.groupBy(F.lit("all").alias("_all")).applyInArrow(rest, "a long, b long, w double")
        taken = last if taken is None else taken.unionByName(last)
    return left if taken is None else taken


def candidates(neighbours: DataFrame) -> DataFrame:
    """Distinct edges a < b of positive weight from neighbour lists (i, j, w)."""
    pairs = neighbours.where("w > 0").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "w")
    return pairs.groupBy("a", "b").agg(F.max("w").alias("w"))


def mutual_best(edges: DataFrame) -> DataFrame:
    """Edges whose ends are each other's best."""
    best = best_by_node(edges)
    return best.join(best.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"]).where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), "w")
