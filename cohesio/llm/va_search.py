"""Exact top-k search by inner product with vector-approximation files.

A vector's approximation holds, for each component, the number of one of 256 cells of equal width between the
component's least and largest value in the table: a byte where the exact component has eight. Components are whole
numbers, so a cell of width w holds w of them. Products of a query with the middles of a vector's cells are off by at
most (w - 1) / 2 times the query's components, so a scan of the approximations gives bounds for every score. Only approximations and queries are dealt out, as pairs of a
block of queries and a block of vectors; a unit keeps what its own bounds can't exclude, then the bounds of all
units together exclude more. Exact vectors are read for what is left, in the order of upper bounds: first for twice
the number asked for, and then for all others whose upper bound isn't below the worst score found, so that the
k-th is certain. Nothing is broadcast or collected but the components' ranges.

Rows with equal vectors are one point, which holds its least vec_ids, one more than asked for: so a vector that a
third of all rows share costs as much as any other, as a candidate and as a query.

Components are taken as floor(scale * x) in double, scores are exact 64-bit integers; where products are too large
for 64 bits they are added up in whole numbers of any size, and a score beyond 64 bits counts as the nearest that fits.
Cases: vectors that are null, or hold null or non-finite components, take no part; vectors of another
length than the query's are no candidates; every other row is one, also those with the query's vec_id or a null
one (the largest); repeated rows each count, as candidates and as queries; ties go to the smaller vec_id; with
fewer than k candidates all are returned; an empty table gives an empty result; columns other than vec_id and
embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohesio.storage import Tables

CELLS = 256
SALTS = 16


def approximate(x: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Cell numbers of vectors, given the lower edges and widths of each component's cells."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor((x - low) / width), 0, CELLS - 1).astype(np.uint8)


def bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every query's product with every vector, from the cells."""
    with np.errstate(all="ignore"):
        half = (width - 1) / 2
        middle = q @ (low + cells * width + half).T
        size = np.abs(q)
        off = size @ half + 1e-9 * (1 + size @ (np.abs(low) + (CELLS + 1) * width))  # half a cell, and rounding
        lower, upper = middle - off[:, None], middle + off[:, None]
    # Where doubles overflow nothing is known.
    unknown = ~(np.isfinite(lower) & np.isfinite(upper))
    lower[unknown], upper[unknown] = -np.inf, np.inf
    return lower, upper


def near_in_block(q: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, lower, upper) of all vectors that a block's own bounds can't exclude from a query's best k + 1.

    The width of a query's bounds is its own, so products with the cells' middles decide; they are taken in single
    precision, whose error widens the bounds. Groups of columns whose largest product is too small aren't looked at.
    """
    n, group = len(codes), 64
    with np.errstate(all="ignore"):
        half = (width - 1) / 2
        middles = np.zeros((n + -n % group, codes.shape[1]), dtype=np.float32)
        for lo in range(0, n, 8192):
            middles[lo : min(lo + 8192, n)] = low + codes[lo : lo + 8192] * width + half
        size, fits = np.abs(q), bool(np.isfinite(middles).all())
        # Below 1e30 it also says that no product overflows.
        off = size @ half + (1e-9 + 2.0**-22 * (codes.shape[1] + 4)) * (1 + size @ (np.abs(low) + (CELLS + 1) * width))
    for lo in range(0, len(q), 64):
        with np.errstate(all="ignore"):
            w = q[lo : lo + 64].astype(np.float32) @ middles.T
            known = np.isfinite(w.sum(axis=1, dtype=np.float64)) & (off[lo : lo + 64] < 1e30)
        if n <= k + 1 or not known.all():  # all are kept, or doubles tell
            for at in range(0, n, 8192):
                lower, upper = bounds(q[lo : lo + 64], codes[at : at + 8192], low, width)
                least = np.full(len(lower), -np.inf)
                if lower.shape[1] > k + 1:
                    least = np.partition(lower, lower.shape[1] - k - 1, axis=1)[:, lower.shape[1] - k - 1]
                i, j = np.nonzero(upper >= least[:, None])
                yield lo + i, at + j, lower[i, j], upper[i, j]
            continue
        some = q[lo : lo + 64].astype(np.float32)
        w = np.empty((len(some), len(middles)), dtype=np.float32)
        groups = w.reshape(len(w), -1, group)
        tops = np.empty(groups.shape[:2], dtype=np.float32)
        for at in range(0, len(middles), 4096):
            np.matmul(some, middles[at : at + 4096].T, out=w[:, at : at + 4096])
            w[:, max(n, at) : at + 4096] = -np.inf
            part = slice(at // group, at // group + 4096 // group)
            groups[:, part].max(axis=2, out=tops[:, part])
        m, own = tops.shape[1], 2 * off[lo : lo + 64]
        floor = np.partition(tops, m - k - 1, axis=1)[:, m - k - 1] if m > k + 1 else np.full(len(w), -np.inf)
        floor = np.nextafter((floor - own).astype(np.float32), np.float32(-np.inf))
        row, place = np.nonzero(tops >= floor[:, None])
        some, column = np.nonzero(groups[row, place] >= floor[row][:, None])
        i, j = row[some], place[some] * group + column
        i, j = i[j < n], j[j < n]
        order = np.lexsort((-w[i, j], i))
        i, j = i[order], j[order]
        v, last = w[i, j].astype(np.float64), np.searchsorted(i, np.arange(len(w))) + k
        fine = v >= (v[last] - own)[i]
        i, j, v = i[fine], j[fine], v[fine]
        yield lo + i, j, v - off[lo + i], v + off[lo + i]


def products(x: np.ndarray, y: np.ndarray) -> list[int]:
    """The exact inner product of each row of x with that of y, at most what 64 bits hold."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if most < 2.0**53:
        return np.einsum("ij,ij->i", x, y).astype(np.int64).tolist()
    if most < 2.0**62:
        return np.einsum("ij,ij->i", x.astype(np.int64), y.astype(np.int64)).tolist()
    exact = (sum(int(a) * int(b) for a, b in zip(p, q)) for p, q in zip(x.tolist(), y.tolist()))
    return [min(max(s, -(2**63)), 2**63 - 1) for s in exact]


def _rows(column: pa.Array, at: np.ndarray, d: int) -> np.ndarray:
    """The lists of length d at these places of a list column, as a matrix."""
    if not d:
        return np.zeros((len(at), 0))
    starts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return flat[starts[at][:, None] + np.arange(d)]


def ranges_of(points: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the lower edges and widths of the components' cells."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(1).to_numpy()
            for size in np.unique(d).tolist():
                x = _rows(batch.column(0), np.flatnonzero(d == size), size)
                if size:
                    yield pa.RecordBatch.from_arrays([pa.array([size] * size, type=pa.int32()), pa.array(np.arange(size, dtype=np.int32)), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["d", "at", "low", "high"])

    found = points.select("x", "d").mapInArrow(task, "d int, at int, low double, high double")
    rows = found.groupBy("d", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row for each component
    out = {}
    for size in {r["d"] for r in rows}:
        own = sorted((r["at"], r["low"], r["high"]) for r in rows if r["d"] == size)
        low, high = (np.array([r[k] for r in own]) for k in (1, 2))
        out[size] = (low, np.ceil(high / CELLS - low / CELLS + 1 / CELLS))
    return out


def top_k(vectors: DataFrame, is_query: Column, store: Tables, k: int = 20, scale: float = 64.0, query_rows: int = 1024, block_rows: int = 4096) -> DataFrame:
    """Each query's k best: query_id, rank (from 1), vec_id, score. is_query: a condition on vec_id."""
    fine = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # Doubles beyond 2^53 are whole; a product with the scale may overflow, and the largest double stands for that.
    largest = F.lit(1.7976931348623157e308)
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, largest), -largest))
    scaled = F.transform("embedding", lambda x: whole(x * scale))
    rows = fine.select("vec_id", scaled.alias("x")).groupBy("vec_id", "x").agg(F.count("*").alias("n"))
    rows = store(rows.select("*", F.xxhash64("x").alias("p1"), F.xxhash64(F.lit(7), "x").alias("p2")), "rows")
    # Hashes come first, so that few vectors are compared.
    least = Window.partitionBy("p1", "p2", "x").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    members = F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id", F.least("n", F.lit(k + 1)).alias("n")))), lambda s: F.struct(s["vec_id"].alias("vec_id"), s["n"].alias("n")))
    points = few.groupBy("p1", "p2", "x").agg(members.alias("members")).withColumn("d", F.size("x"))
    asked = rows.where(is_query).select("p1", "p2").distinct().withColumn("asked", F.lit(True))
    points = store(points.join(asked, ["p1", "p2"], "left").select("*", F.monotonically_increasing_id().alias("id")), "points")
    cells = ranges_of(points)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, out = batch.column(2).to_numpy(), [b""] * batch.num_rows
            for size in np.unique(d).tolist():
                at = np.flatnonzero(d == size)
                if size:
                    codes = approximate(_rows(batch.column(1), at, size), *cells[size])
                    for i, c in zip(at.tolist(), codes):
                        out[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary()), batch.column(2)], names=["id", "cells", "d"])

    n, n_asked = points.count(), points.where("asked").count()
    # A unit holds several blocks where there are many, since each keeps k + 1 for each of its queries at least.
    vb, qb = (max(min(8, -(-rows // size)), -(-rows // (most * size)), 1) for rows, size, most in ((n, block_rows, 16), (n_asked, query_rows, 4)))
    block = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    approximations = points.select("id", "x", "d").mapInArrow(scan, "id long, cells binary, d int").select("d", every(qb).alias("qb"), block(vb, 1).alias("vb"), "id", "cells", F.lit(None).cast("array<double>").alias("x"))
    questions = points.where("asked").select("d", block(qb, 2).alias("qb"), every(vb).alias("vb"), "id", F.lit(None).cast("binary").alias("cells"), "x")

    def meet(table: pa.Table) -> pa.Table:
        table, out = table.combine_chunks(), []
        ids, size = table["id"].to_numpy(), table["d"][0].as_py()
        is_q = np.array(table["cells"].is_null())
        qs, vs = np.flatnonzero(is_q), np.flatnonzero(~is_q)
        if len(qs) and len(vs):
            x = table["x"].combine_chunks() if isinstance(table["x"], pa.ChunkedArray) else table["x"]
            q = _rows(x, qs, size)
            codes = np.frombuffer(b"".join(table["cells"].take(pa.array(vs)).to_pylist()), dtype=np.uint8).reshape(len(vs), size)
            low, width = cells.get(size, (np.zeros(0), np.zeros(0)))
            out = [(ids[qs[i]], ids[vs[j]], lower, upper) for i, j, lower, upper in near_in_block(q, codes, low, width, k)]
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, dtype=np.int64)] * 2 + [np.empty(0)] * 2
        return pa.table({name: pa.array(c) for name, c in zip(("q", "id", "lower", "upper"), columns)})

    units = approximations.unionByName(questions).repartition(vb * qb, "d", "qb", "vb").groupBy("d", "qb", "vb")
    near = store(units.applyInArrow(meet, "q long, id long, lower double, upper double"), "near")

    def worst(found: DataFrame, by: str) -> DataFrame:
        """The (k + 1)-th largest of each query, where there are so many."""
        order = Window.partitionBy("q").orderBy(F.desc(by))
        return found.select("q", by, F.row_number().over(order).alias("r")).where(F.col("r") <= k + 1).where(F.col("r") == k + 1).select("q", F.col(by).alias("worst"))

    may = near.join(worst(near, "lower"), "q", "left").where("worst is null or upper >= worst").drop("worst")
    may = store(may.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("upper"), "id"))), "may")
    exact = points.select("id", "x")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            size, out = np.diff(x.offsets.to_numpy()), np.zeros(batch.num_rows, dtype=np.int64)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                out[at] = products(_rows(x, at, d), _rows(y, at, d))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["q", "id", "score"])

    def read(wanted: DataFrame) -> DataFrame:
        asked_x = exact.select(F.col("id").alias("q"), F.col("x").alias("qx"))
        return wanted.select("q", "id").join(exact, "id").join(asked_x, "q").select("q", "id", "qx", "x").mapInArrow(score, "q long, id long, score long")

    first = store(read(may.where(F.col("r") <= 2 * (k + 1))), "first")
    left = may.where(F.col("r") > 2 * (k + 1)).join(worst(first, "score"), "q").where("upper >= worst")
    scored = first.unionByName(read(left))
    # The best k + 1 rows are in the best k + 1 points, by score and least vec_id.
    best = scored.join(points.select("id", "members"), "id")
    lead = F.col("members")[0]["vec_id"].asc_nulls_last()
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), lead, "id"))).where(F.col("r") <= k + 1)
    each = best.select("q", "id", "score", F.explode("members").alias("m")).select("q", "id", "score", "m.vec_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m.n"))).alias("copy"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "id", "copy")
    ranked = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "vec_id", "score"))).alias("found"))
    # Many queries may be one point, so its list is salted.
    lists = lists.join(points.select(F.col("id").alias("q"), "p1", "p2"), "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    queries = rows.where(is_query).select("p1", "p2", F.col("vec_id").alias("query_id"), "n", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    answers = queries.join(store(lists, "lists"), ["p1", "p2", "salt"])
    own = F.array_position(F.transform("found", lambda s: (s["id"] == F.col("q")) & s["vec_id"].eqNullSafe(F.col("query_id"))), True)
    others = F.slice(F.filter("found", lambda s, i: i + 1 != F.col("own")), 1, k)
    answers = answers.withColumn("own", own).select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"), others.alias("others"))
    out = answers.select("query_id", F.posexplode("others").alias("place", "s"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), "s.vec_id", "s.score")
