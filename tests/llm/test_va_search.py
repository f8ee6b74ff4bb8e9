import math

import numpy as np
from pyspark.sql import functions as F

from cohesio.llm import shared, va_search


def store(spark):
    return shared.Tables(spark, "t")


def brute(rows, queries, k, scale=64.0):
    """All rows by place; a score beyond 64 bits is the nearest that fits."""
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(fine):
        if i is not None and queries(i):
            score = lambda v: min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1)
            found = sorted((-score(v), j is None, j or 0) for place, (j, v) in enumerate(fine) if place != at and len(v) == len(q))[:k]
            out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(found, 1)]
    return sorted(out, key=str)


def check(spark, rows, k, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long")
    got = va_search.top_k(df, F.col("vec_id") % 5 == 0, store(spark), k=k, **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda i: i % 5 == 0, k)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), i) for i in range(300)]
    rows += [(300 + i, rows[i][1], 0) for i in range(40)]  # ties
    rows += [(400, None, 0), (405, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (410, [float("nan")] * 6, 0), (415, [float("inf")] * 6, 0), (None, rows[5][1], 0), (None, [0.0] * 6, 0), (420, [], 0), (421, [], 0), (425, [1.0, 2.0], 0), (430, [1.0, -2.0], 0), (435, [0.0] * 6, 0), (440, [-0.0] * 6, 0)]
    check(spark, rows, 5, query_rows=16, block_rows=64)
    check(spark, rows, 400, query_rows=20, block_rows=50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long")
    assert va_search.top_k(df.limit(0), F.col("vec_id") % 5 == 0, store(spark)).count() == 0


def test_repeated_ids_and_a_common_vector(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(size=4).tolist()
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.0], 0), (1, [0.8, 0.0], 0), (0, [0.7, 0.0], 0)]
    rows += [(10 + i, common, 0) for i in range(150)] + [(10, common, 0)] * 3 + [(None, common, 0)] * 2
    rows += [(200 + i, rng.normal(size=4).tolist(), 0) for i in range(100)]
    check(spark, rows, 4, query_rows=8, block_rows=32)
    check(spark, rows, 60)


def test_huge_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 30)).tolist(), 0) for i in range(80)] + [(100, [1e300, -1e300, 1e200], 0), (105, [1.7e308, 1.0, -1.7e308], 0), (110, [2.0**54, 1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long")
    got = va_search.top_k(df, F.col("vec_id") % 5 == 0, store(spark), k=7, scale=1.0)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda i: i % 5 == 0, 7, 1.0)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    q, v = rng.integers(-64, 64, (20, 9)).astype(float), rng.integers(-6400, 6400, (500, 9)).astype(float)
    v[:, 3] = 5
    for x, least in ((v, 0.02), (v // 60, 1e-6)):
        low, width = x.min(axis=0), np.ceil((np.ptp(x, axis=0) + 1) / va_search.CELLS)
        lower, upper = va_search.bounds(q, va_search.approximate(x, low, width), low, width)
        assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all() and (upper - lower).mean() < least * np.ptp(q @ x.T)
