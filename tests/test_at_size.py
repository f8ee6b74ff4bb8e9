"""What keeps queries within their limits on larger tables, on small ones."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohesio import queries
from cohesio.llm import va_search
from cohesio.operators import neighbours, objective, pairs
from cohesio.plans import lazy, rounds, sequential
from cohesio.sources.problem import Problem
from cohesio.storage import Tables
from tests.test_engine import labels_of, literal_lazy, problem


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    """A folder with 300 vectors in 12 labels, some of them equal."""
    at = tmp_path_factory.mktemp("table")
    x = np.random.default_rng(3).normal(size=(300, 8)).astype(np.float32)
    x[200:220] = x[10]
    rows = pa.table({"vec_id": pa.array(np.arange(300)), "embedding": pa.array(list(x), type=pa.list_(pa.float32())), "label": pa.array(np.arange(300) % 12, type=pa.int32())})
    pq.write_table(rows, at / "embeddings.parquet")
    return at


def agrees(spark, table, name):
    """A query's rows are those of its SQL."""
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{table}/embeddings.parquet'")
    got = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in got.description]
    want, mine = sorted(got.fetchall()), sorted(tuple(r) for r in queries.QUERIES[name](spark, str(table)).select(columns).collect())
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert a == pytest.approx(b, abs=2e-6)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


PAIRS = ["pair_weights", "best_edge", "contract_edges", "labeling_cost", "positive_edges", "non_negative_edges"]


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_by_products(spark, table, name):
    """No pair passes through functions on arrays one at a time."""
    assert "zip_with" not in plan(queries.QUERIES[name](spark, str(table)))
    agrees(spark, table, name)


ODD = [(1, [1.0, 2.0], 1), (2, None, 2), (3, [1.0, None], 1), (4, [1.0], None), (5, [0.5, 0.25], 2), (5, [3.0, 0.0], 1), (None, [1.0, 1.0], 2), (6, [], 3), (7, [0.5, 0.0], 2)]


def odd(spark):
    """Nodes and labels with nulls, uneven lengths and a repeated id."""
    rows = spark.createDataFrame(ODD, "node_id long, features array<double>, cluster long")
    return rows.select("node_id", "features"), rows.select("node_id", "cluster").where("node_id <> 5").unionByName(spark.createDataFrame([(5, 2)], "node_id long, cluster long"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def no_pairs(*_):
    raise AssertionError("pairs leave their task")


def test_best_edge_within_units(spark, table, monkeypatch):
    nodes, _ = odd(spark)
    want = rows_of(pairs.best_edge(pairs.pair_weights(nodes, 0.5, 1)))
    assert rows_of(pairs.best_pair(nodes, 0.5, 1)) == want == [(1, 5, 2.5)]
    voids = nodes.where("node_id in (2, 3, 4)")
    assert rows_of(pairs.best_pair(voids, 0.5, 1)) == rows_of(pairs.best_edge(pairs.pair_weights(voids, 0.5, 1))) == [(2, 3, None)]
    assert rows_of(pairs.best_pair(nodes.limit(0), 0.5, 1)) == []
    monkeypatch.setattr(pairs, "pair_weights", no_pairs)
    agrees(spark, table, "best_edge")


def test_edges_contracted_within_units(spark, table, monkeypatch):
    nodes, labels = odd(spark)
    assert rows_of(pairs.cluster_edges(nodes, labels, 0.5, 1)) == rows_of(pairs.contract_edges(pairs.pair_weights(nodes, 0.5), labels, 1))
    monkeypatch.setattr(pairs, "pair_weights", no_pairs)
    agrees(spark, table, "contract_edges")


def test_cost_within_units(spark, table, monkeypatch):
    nodes, labels = odd(spark)
    want = pairs.contract_edges(pairs.pair_weights(nodes, 0.5), labels).selectExpr("round(coalesce(sum(w), 0), 6)").first()[0]
    assert objective.labeling_cost_by_pairs(nodes, labels, 0.5).first()[0] == pytest.approx(want)
    assert objective.labeling_cost_by_pairs(nodes.limit(0), labels, 0.5).first()[0] == 0
    monkeypatch.setattr(pairs, "pair_weights", no_pairs)
    monkeypatch.setattr(objective, "pair_weights", no_pairs, raising=False)
    agrees(spark, table, "labeling_cost")


def test_positive_edges_within_units(spark, table, monkeypatch):
    nodes, _ = odd(spark)
    assert rows_of(pairs.weights_over(nodes, 0.5, 1)) == rows_of(pairs.positive(pairs.pair_weights(nodes, 0.5, 1)))
    monkeypatch.setattr(pairs, "pair_weights", no_pairs)
    agrees(spark, table, "positive_edges")


def test_non_negative_edges_within_units(spark, table, monkeypatch):
    nodes, _ = odd(spark)
    got = rows_of(pairs.weights_over(nodes, 0.5, 1, zero=True))
    assert got == rows_of(pairs.non_negative(pairs.pair_weights(nodes, 0.5, 1))) and (1, 7, 0.0) in got
    monkeypatch.setattr(pairs, "pair_weights", no_pairs)
    agrees(spark, table, "non_negative_edges")


def test_pairs_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.5, 0.25]), (5, [3.0, 0.0]), (None, [1.0, 1.0]), (6, [])]
    nodes = spark.createDataFrame(rows, "node_id long, features array<double>")
    got = {(r.a, r.b, r.w) for r in pairs.pair_weights(nodes, 0.5, 1).collect()}
    assert {e for e in got if e[2] is not None} == {(1, 5, 0.5), (1, 5, 2.5)}
    assert {e[:2] for e in got} == {(a, b) for a in range(1, 7) for b in range(a + 1, 7)}


def test_rounded_half_away_from_zero():
    w = np.array([0.25, -0.25, -0.04, 1e300, -np.inf, np.nan])
    got = pairs.rounded(w, 1)
    assert got[:5].tolist() == [0.3, -0.3, 0.0, 1e300, -np.inf] and np.isnan(got[5]) and not np.signbit(got[2])
    assert pairs.rounded(w[:3], 1).tolist() == [0.3, -0.3, 0.0]


def test_matrix_of_more_nodes():
    """More than 10,000 nodes, of which two make a cluster."""
    x = np.zeros((10_260, 2))
    x[[3, 9_000]] = 1
    label, done = sequential.by_matrix(x, 0.5)
    assert done == [1.5] and np.flatnonzero(label != np.arange(len(x))).tolist() == [9_000] and label[9_000] == 3


def test_matrix_with_ties():
    """The ways agree where many weights are equal, so that stale rows lead."""
    x = np.round(np.random.default_rng(8).normal(size=(150, 3)), 1)
    assert sequential.by_matrix(x, 0.1)[0].tolist() == sequential.by_nearest(x, 0.1)[0].tolist()


@pytest.mark.parametrize("way", ["dense_gaec", "dense_gaec_inc"])
def test_sequential_rows_are_held(way, monkeypatch):
    """Most steps find the rows of weights they need at hand, and places that move change nothing."""
    x, calls, need = np.random.default_rng(7).normal(size=(900, 6)), [], sequential._Rows.need
    monkeypatch.setattr(sequential._Rows, "need", lambda *a: (calls.append(1), need(*a)))
    label, done = sequential.WAYS[way](x, 0.2, *((5, 5) if way == "dense_gaec_inc" else ()))
    assert label.tolist() == sequential.by_matrix(x, 0.2)[0].tolist() and 0 < len(calls) < len(done)


def test_bounds_in_single_precision():
    """A block keeps all that its bounds in double can't exclude, and little more; scores lie in the bounds."""
    x = np.floor(np.random.default_rng(4).normal(size=(5_000, 16)) * 3_000)
    low, width = x.min(axis=0), np.ceil(x.max(axis=0) / 256 - x.min(axis=0) / 256 + 1 / 256)
    codes, q = va_search.approximate(x, low, width), x[:70]
    i, j, lower, upper = (np.concatenate(c) for c in zip(*va_search.near_in_block(q, codes, low, width, 20)))
    below, above = va_search.bounds(q, codes, low, width)
    must = set(zip(*(c.tolist() for c in np.nonzero(above >= np.partition(below, 4_979, axis=1)[:, [4_979]]))))
    have = set(zip(i.tolist(), j.tolist()))
    assert must <= have and len(have) == len(i) < 1.1 * len(must)
    exact = (q[i] * x[j]).sum(axis=1)
    assert (lower <= exact).all() and (exact <= upper).all()


def test_steps_write_edges_of_the_union_alone(spark, monkeypatch):
    x = np.random.default_rng(5).uniform(-1, 1, (60, 4))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, features array<double>")
    rows, call = [], Tables.__call__

    def counted(self, df, name):
        rows.append((kept := call(self, df, name)).count())
        return kept

    monkeypatch.setattr(Tables, "__call__", counted)
    found = rounds.sequential_by_edges(Problem(nodes, 0.0), 3)
    assert rows == [1770, 58, 57, 56] and found.select("cluster").distinct().count() == 57


def test_matrix_holds_a_pair_once():
    """Several instances share an executor, so each takes about four bytes a pair of ids."""
    x = np.random.default_rng(2).normal(size=(1_500, 4))
    tracemalloc.start()
    sequential.by_matrix(x, 9.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * 1_500**2


def test_search_leaves_out_by_single_precision():
    """Rows are those of doubles, also with copies, sizes and fewer columns than groups."""
    rng = np.random.default_rng(6)
    for n, k in ((30, 3), (900, 1), (900, 3)):
        x, size, ids = rng.normal(size=(n, 12)), rng.integers(1, 9, n), rng.permutation(n)
        x[: n // 10], x = x[0], x * size[:, None]
        size[: n // 10] = size[0]
        x[: n // 10] = x[0]
        t = pa.table({"cluster": ids, "size": size, "fsum": pa.array(list(x), type=pa.list_(pa.float64()))})
        both = pa.concat_tables([t.append_column("is_query", pa.array([q] * n)) for q in (True, False)])
        got = neighbours.best_in_block(both, k, 0.2, 6)
        w = np.round(x @ x.T - 0.2 * np.outer(size, size), 6)
        want = {(int(ids[i]), int(ids[j])) for i in range(n) for j in sorted((j for j in range(n) if j != i), key=lambda j: (-w[i, j], ids[j]))[:k]}
        assert set(zip(got["i"].to_pylist(), got["j"].to_pylist())) == want and got.num_rows == n * k


def test_few_products_are_weighed_in_double():
    rng = np.random.default_rng(9)
    q, base = rng.normal(size=(100, 12)), rng.normal(size=(4_096, 12))
    longest = float(np.sqrt((base**2).sum(axis=1).max()))
    found = neighbours.candidates_of(q, base.astype(np.float32), 4_096, longest, (np.arange(100), np.arange(100)), 1)
    assert 100 <= len(found[0]) < 300


def test_search_by_columns(spark, table):
    """Whole vectors are columns, and no weight passes through functions on arrays; others keep the general way."""
    assert "zip_with" not in plan(queries.QUERIES["knn5_expr"](spark, str(table)))
    agrees(spark, table, "knn5_expr")
    rows = [(1, 1, [1.0, 2.0]), (2, 1, [2.0, 1.0]), (3, 2, [1.0, 1.0]), (4, 1, [1.0, None])]
    clusters = spark.createDataFrame(rows, "cluster long, size long, fsum array<double>")
    index = neighbours.Index("expr")
    assert "zip_with" in plan(neighbours.nearest(clusters, 2, 0.5, index))
    whole = clusters.where("cluster < 4")
    assert rows_of(neighbours.nearest(whole, 5, 0.5, index)) == rows_of(neighbours.nearest(whole, 5, 0.5))


def test_rounds_store_little(spark, monkeypatch):
    """A round stores its candidates once, and a search is told how many clusters there are."""
    x = np.random.default_rng(5).uniform(-1, 1, (60, 4))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, features array<double>")
    names, told, call, search = [], [], Tables.__call__, neighbours.by_blocks
    monkeypatch.setattr(Tables, "__call__", lambda self, df, name: (names.append(name), call(self, df, name))[1])
    monkeypatch.setattr(neighbours, "by_blocks", lambda *a, **k: (told.append(k["n"]), search(*a, **k))[1])
    found = rounds.parallel_gaec(Problem(nodes, 0.2), small=0)
    assert len(names) == 1 + 4 * len(found.rounds) + 2 and told[0] == (60, 60) and told[-1] == (found.clusters(),) * 2
    monkeypatch.undo()
    assert rows_of(found.labels) == rows_of(rounds.parallel_gaec(Problem(nodes, 0.2)).labels)


def hub(n=40):
    """A vector that takes in n others one at a time, as none of these is positive to another."""
    x = np.zeros((n + 1, n + 1))
    x[0, 0], x[1:, 0] = 5.0, np.random.default_rng(4).uniform(0.38, 0.4, n)
    x[np.arange(1, n + 1), np.arange(1, n + 1)] = 0.5
    return x


LAZY = {
    "dense_laec": {"small_nodes": 20},
    "dense_laec_bf_later": {"index": neighbours.Index("ivf", 4, 4), "later": "faiss_brute_force", "small_nodes": 20},
    "dense_laec_bf_later_all_cells": {"index": neighbours.Index("ivf", 8, 8), "later": "faiss_brute_force", "small_nodes": 30},
    "dense_laec_rounds": {"small_nodes": 0},
}


@pytest.mark.parametrize("name", LAZY)
def test_lazy_steps_on_few_edges(spark, monkeypatch, name):
    x, names, put = hub(), [], Tables.__call__
    monkeypatch.setattr(Tables, "__call__", lambda self, df, name: names.append(name) or put(self, df, name))
    p, (want, rounds_) = problem(spark, x, 0.2), literal_lazy(x, 0.2, 5, 5)
    found = lazy.dense_laec(p, **LAZY[name])
    assert labels_of(found.labels) == want and found.rounds == rounds_ and rounds_[0] > 30
    assert len(names) < 12
    names.clear()
    found = lazy.dense_laec(p, **LAZY[name], small_edges=34)
    assert labels_of(found.labels) == want and found.rounds == rounds_ and any(x.startswith("merged-1-") for x in names)


def test_lazy_steps_spread(spark):
    x = np.random.default_rng(12).uniform(-1, 1, (50, 5))
    p, (want, rounds_) = problem(spark, x, 0.3), literal_lazy(x, 0.3, 3, 2)
    found = lazy.dense_laec(p, 3, 2, small_nodes=0, small_edges=0)
    assert labels_of(found.labels) == want and found.rounds == rounds_


def test_edges_in_strips(spark, monkeypatch):
    """Rounds over edges give equal labels spread or in a task, and store no row for each pair."""
    rng = np.random.default_rng(13)
    rows = [(3 * i, v.tolist()) for i, v in enumerate(rng.uniform(-1, 1, (60, 5)))]
    rows[7], rows[9] = (21, None), (27, [None, *rows[9][1][1:]])
    p = Problem(spark.createDataFrame(rows, "node_id long, features array<double>"), 0.2)
    stored, put = {}, Tables.__call__
    monkeypatch.setattr(Tables, "__call__", lambda self, df, name: stored.setdefault(name, put(self, df, name)))
    monkeypatch.setattr(rounds, "STRIP", 500)
    spread = rounds.parallel_by_edges(p, small=0)
    assert len(spread.rounds) > 3 and stored[f"edges-{len(spread.rounds)}"].count() == 60 - sum(spread.rounds)
    assert max(df.count() for name, df in stored.items() if name.startswith("edges-" + str(len(spread.rounds)))) <= 60 and "edges-0" not in stored
    monkeypatch.undo()
    some = [rounds.parallel_by_edges(p, small=n) for n in (30, 4096)]
    assert all(s.rounds == spread.rounds and rows_of(s.labels) == rows_of(spread.labels) for s in some)
    fine = Problem(p.nodes.where("node_id not in (21, 27)"), 0.2)
    assert rows_of(spread.labels.where("node_id not in (21, 27)")) == rows_of(rounds.parallel_gaec(fine).labels)
    assert rows_of(spread.labels.where("node_id in (21, 27)")) == [(21, 21), (27, 27)]


def test_cells_share_a_unit(spark, monkeypatch):
    """A query that looks into most cells is sent once for all cells of a unit, and loses no neighbour by that."""
    x, k = np.random.default_rng(14).normal(size=(240, 6)), 4
    clusters = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "cluster long, size long, fsum array<double>")
    found, top = [], neighbours.top
    monkeypatch.setattr(neighbours, "top", lambda df, k: (found.append(df.count()), top(df, k))[1])
    w, centres = np.round(x @ x.T - 0.1, 9), neighbours.cell_centres(clusters, 8)
    home, order = neighbours.nearest_cell(x, centres), neighbours.cell_order(np.ones(240), x, centres, 0.1)
    for probes, rows in ((8, 4096), (8, 30), (5, 4096), (5, 30), (2, 4096), (2, 15)):
        found.clear()
        near = neighbours.by_cells(clusters, clusters, k, 0.1, neighbours.Index("ivf", 8, probes), block_rows=rows)
        got = {(r.i, r.rank): r.j for r in near.collect()}
        for i in range(240):
            inside = [j for j in np.flatnonzero(np.isin(home, order[i, :probes])) if j != i]
            want = sorted(inside, key=lambda j: (-w[i, j], j))[:k]
            assert [got.get((i, r + 1)) for r in range(k)] == [*want, *[None] * (k - len(want))]
        if probes > 4 and rows == 4096:
            assert found == [240 * k]


def test_a_lazy_step_stores_two_tables(spark, monkeypatch):
    """A distributed step stores the clusters it made and the graph between them, which tells the next best edges."""
    x, names, put = np.random.default_rng(15).uniform(-1, 1, (50, 5)), [], Tables.__call__
    p, (want, rounds_) = problem(spark, x, 0.3), literal_lazy(x, 0.3, 4, 3)
    monkeypatch.setattr(Tables, "__call__", lambda self, df, name: names.append(name) or put(self, df, name))
    found = lazy.dense_laec(p, 4, 3, index=neighbours.Index("ivf", 8, 8), later="faiss_brute_force", small_nodes=0, small_edges=0)
    assert labels_of(found.labels) == want and found.rounds == rounds_
    steps = [name for name in names if name.count("-") == 2 and not name.startswith("labels")]
    assert len(steps) > 4 and all(steps[n].split("-")[1:] == steps[n + 1].split("-")[1:] for n in range(0, len(steps), 2)) and len(set(steps[::2])) == len(steps) // 2 == len({name.split("-", 1)[1] for name in steps})


def test_ranked_edges(spark):
    """The best edges and the capped ones, also where a row comes twice."""
    rng = np.random.default_rng(16)
    edges = {(int(min(e)), int(max(e))): float(w) for e, w in zip(rng.integers(0, 30, (90, 2)), rng.integers(1, 9, 90)) if e[0] != e[1]}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    at_a, at_b = lazy.ranked_here(tuple(np.array(c) for c in zip(*rows)))
    got = lazy.ranked(spark.createDataFrame(rows + rows[::3], "a long, b long, w double"), 2)
    assert rows_of(got) == sorted(((*e, i == j == 0) for e, i, j in zip(rows, at_a.tolist(), at_b.tolist()) if min(i, j) < 2), key=repr)


@pytest.mark.parametrize("way", ["dense_gaec", "dense_gaec_inc"])
def test_a_merge_fills_one_list(way, monkeypatch):
    """Lists of other clusters are looked at when they lead alone; large clusters' weights are found in double."""
    rng, calls, best = np.random.default_rng(17), [], sequential._Rows.best_of_held
    monkeypatch.setattr(sequential._Rows, "best_of_held", lambda *a: (calls.append(1), best(*a))[1])
    for x in (rng.normal(size=(900, 6)), np.round(rng.normal(size=(400, 3)) + [2, 0, 0], 1)):
        calls.clear()
        label, done = sequential.WAYS[way](x, 0.2, *((5, 5) if way == "dense_gaec_inc" else ()))
        want, gained = sequential.by_matrix(x, 0.2)
        assert label.tolist() == want.tolist() and done == pytest.approx(gained)
        assert np.bincount(label).max() > sequential.BIG and len(done) <= len(calls) < 4 * len(done)


def test_gaec_beyond_its_matrix(spark, monkeypatch):
    """An instance that is too large for a matrix is solved all the same, with equal labels."""
    p = problem(spark, np.random.default_rng(18).normal(size=(90, 4)), 0.2)
    want = sorted((r.node_id, r.cluster) for r in sequential.solve(p.nodes, p.offset, "gaec").collect())
    x = np.random.default_rng(18).normal(size=(90, 4))
    monkeypatch.setattr(sequential, "MOST_MATRIX_NODES", 80)
    with pytest.raises(ValueError, match="too many"):
        sequential.by_matrix(x, 0.2)
    label, done = sequential.WAYS["gaec"](x, 0.2)
    assert [(i, int(c)) for i, c in enumerate(label)] == want and len(done) == 90 - len({c for _, c in want})


@pytest.mark.parametrize("seed", range(3))
def test_steps_store_edges_that_may_lead(spark, monkeypatch, seed):
    """Steps over few stored edges give the labels of steps over all, with hubs, ties, nulls and one block or more."""
    rng = np.random.default_rng(seed)
    x = [hub(30), np.round(rng.uniform(-1, 1, (50, 2)), 1), rng.normal(size=(50, 4))][seed]
    rows = [(3 * i, v.tolist()) for i, v in enumerate(x)]
    rows[7], rows[9] = (21, None), (27, [None, *rows[9][1][1:]])
    p = Problem(spark.createDataFrame(rows, "node_id long, features array<double>"), 0.1)
    want, stored, put = rows_of(rounds.sequential_by_edges(p, 6)), {}, Tables.__call__
    monkeypatch.setattr(Tables, "__call__", lambda self, df, name: stored.setdefault(name, put(self, df, name)))
    monkeypatch.setattr(rounds, "WHOLE", 5)
    monkeypatch.setattr(pairs, "pair_weights", no_pairs)
    assert rows_of(rounds.sequential_by_edges(p, 6)) == want and len({c for _, c in want}) == len(rows) - 6
    assert stored["union-6"].count() == len(rows) - 7 and stored["edges-0"].count() < len(rows) * (len(rows) - 1) // 2


def test_pairs_are_sent_few_times(spark, monkeypatch):
    """Blocks of pairs grow with the table, as shuffles of each node to each block do not fit the disk."""
    sizes, over = [], pairs.over_pairs
    monkeypatch.setattr(pairs, "over_pairs", lambda *a, **k: (sizes.append(a[5]), over(*a, **k))[1])
    nodes = spark.range(60_000).selectExpr("id as node_id", "array(1.0D, id) as features")
    pairs.pair_weights(nodes, 0.1, 6)
    assert sizes == [5000]
    x = np.random.default_rng(19).normal(size=(70, 3))
    got = {(r.a, r.b): r.w for r in pairs.pair_weights(problem(spark, x, 0.1).nodes, 0.1, 6).collect()}
    assert got == {(i, j): pytest.approx(x[i] @ x[j] - 0.1, abs=1e-6) for i in range(70) for j in range(i + 1, 70)}


def test_edges_are_not_stored_of_many_nodes(spark, monkeypatch):
    """Rounds that weigh edges when they look for the best give the labels of rounds over stored edges."""
    x = np.random.default_rng(20).uniform(-1, 1, (80, 5))
    p = problem(spark, x, 0.2)
    want, names, put = rounds.parallel_by_edges(p), [], Tables.__call__
    labels = rows_of(want.labels)
    monkeypatch.setattr(Tables, "__call__", lambda self, df, name: (names.append(name), put(self, df, name))[1])
    monkeypatch.setattr(rounds, "STORED", 70)
    monkeypatch.setattr(rounds, "HERE", 50)
    for small in (30, 0):
        names.clear()
        found = rounds.parallel_by_edges(p, small=small)
        assert found.rounds == want.rounds and rows_of(found.labels) == labels and "clusters-1" in names and not any(n.startswith("edges-") for n in names)
    odd = Problem(p.nodes.selectExpr("node_id", "if(node_id = 7, null, features) as features"), 0.2)
    assert (7, 7) in rows_of(rounds.parallel_by_edges(odd, small=30).labels) and "edges-1" in names


def test_rounds_look_at_what_changed():
    """The nearest found anew where they may have changed are those of all clusters weighed each round."""
    rng = np.random.default_rng(21)
    for x in (np.round(rng.normal(size=(120, 3)), 1), rng.normal(size=(300, 6)), hub(30)):
        final, size, sums, counts = np.arange(len(x)), np.ones(len(x)), x.copy(), []
        while True:
            w = np.round(sums @ sums.T - 0.2 * np.outer(size, size), 9)
            w[:, size == 0] = w[size == 0] = -np.inf
            np.fill_diagonal(w, -np.inf)
            edges = {(min(i, j), max(i, j)): w[i, j] for i, j in enumerate(w.argmax(axis=1).tolist()) if w[i, j] > 0}
            used, found = set(), []
            for a, b in sorted(edges, key=lambda e: (-edges[e], e)):
                if not used & {a, b}:
                    used |= {a, b}
                    found.append((a, b))
            if not found:
                break
            counts.append(len(found))
            for a, b in found:
                sums[a], size[a], size[b], final[final == b] = sums[a] + sums[b], size[a] + size[b], 0, a
        to, done = rounds.rounds_here(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x, 0.2, 9)
        assert to.tolist() == final.tolist() and done == counts
