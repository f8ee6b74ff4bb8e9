import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohesio import queries
from cohesio.functions import vectors
from cohesio.operators import contraction, matching, neighbours, objective, pairs
from cohesio.plans import api, lazy, rounds, sequential
from cohesio.sources.problem import HEADER, Problem, write_labels
from cohesio.storage import keeper

#: Hand-computed instances: features, offset, all-cut cost, partition, final cost.
INSTANCES = {
    "two_pairs": ([(1, 0), (1, 0), (0, 1), (0, 1)], 0.5, -1.0, [0, 0, 2, 2], -2.0),
    "line": ([(1,), (2,), (-1,)], 0.0, -1.0, [0, 0, 2], -3.0),
    "identical": ([(1,)] * 3, 0.0, 3.0, [0, 0, 0], 0.0),
    "all_apart": ([(1, 0), (0, 1)], 1.0, -1.0, [0, 1], -1.0),
    "zero_edge": ([(1, 0), (0, 1)], 0.0, 0.0, [0, 1], 0.0),
    "single": ([(1,)], 0.0, 0.0, [0], 0.0),
}


def problem(spark, x, offset):
    x = np.asarray(x, dtype=float)
    return Problem.from_flat(spark, x.reshape(-1), len(x), x.shape[1] if x.ndim > 1 else 0, offset)


def labels_of(df):
    return [r.cluster for r in df.orderBy("node_id").collect()]


def cost(x, offset, label):
    return sum(float(np.dot(x[i], x[j])) - offset for i, j in itertools.combinations(range(len(x)), 2) if label[i] != label[j])


def greedy(x, offset):
    """Sequential greedy contraction, literally."""
    label, w = list(range(len(x))), {(i, j): round(float(np.dot(x[i], x[j])) - offset, 9) for i, j in itertools.combinations(range(len(x)), 2)}
    while w:
        (a, b), best = min(w.items(), key=lambda e: (-e[1], e[0]))
        if best <= 0:
            break
        label, new = [a if c == b else c for c in label], {}
        for (i, j), v in w.items():
            i, j = (a if i == b else i), (a if j == b else j)
            if i != j:
                key = (min(i, j), max(i, j))
                new[key] = round(new.get(key, 0) + v, 9)
        w = new
    return label


@pytest.mark.parametrize("name", INSTANCES)
def test_hand_computed(spark, name):
    x, offset, apart, label, final = INSTANCES[name]
    p = problem(spark, x, offset)
    assert objective.all_cut_cost(p.nodes, offset).first().cost == pytest.approx(apart)
    for solver in ("gaec", "dense_gaec", "dense_gaec_inc", "parallel_gaec", "dense_laec"):
        found = api.solve(p, solver)
        assert labels_of(found.labels) == label, solver
        assert found.cost() == pytest.approx(final) and found.clusters() == len(set(label))
        assert found.contractions == len(label) - len(set(label))


@pytest.mark.parametrize("n,d,offset", [(10, 16, 0.0), (20, 32, 0.5), (50, 16, 0.0), (60, 8, 0.3)])
def test_sequential_solvers_agree_with_brute_force(n, d, offset):
    x = np.random.default_rng(n).uniform(-1, 1, (n, d))
    want = greedy(x, offset)
    for label, done in (sequential.by_matrix(x, offset), sequential.by_nearest(x, offset), sequential.by_lists(x, offset, 1, 1), sequential.by_lists(x, offset, 4, 7)):
        assert label.tolist() == want
        assert cost(x, offset, want) == pytest.approx(cost(x, offset, range(n)) - sum(done), abs=1e-6)


@pytest.mark.parametrize("n,d", [(100, 16), (200, 64), (1000, 1024)])
def test_sequential_solvers_agree(n, d):
    x = np.random.default_rng(1).uniform(-1, 1, (n, d))
    found = [f(x, *a) for f, a in ((sequential.by_matrix, (0.0,)), (sequential.by_nearest, (0.0,)), (sequential.by_lists, (0.0, 1, 1)), (sequential.by_lists, (0.0, 5, 8)))]
    assert all((found[0][0] == f[0]).all() for f in found[1:])


def test_instances_are_solved_apart(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (30, 4))
    nodes = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "node_id long, features array<double>, part int")
    got = {r.node_id: r.cluster for r in sequential.solve(nodes, 0.1, "gaec", instance="part").collect()}
    for part in range(3):
        ids = [k for k in range(30) if k % 3 == part]
        assert [got[k] for k in ids] == [ids[c] for c in greedy(x[ids], 0.1)]
    with pytest.raises(ValueError):
        sequential.by_matrix(np.zeros((sequential.MOST_MATRIX_NODES + 1, 1)), 0)


def test_declarative_steps(spark):
    x = np.random.default_rng(5).uniform(-1, 1, (12, 4))
    p = problem(spark, x, 0.0)
    got = labels_of(rounds.sequential_by_edges(p, 12))
    assert got == greedy(x, 0.0)


def literal_rounds(x, offset):
    label = list(range(len(x)))
    while True:
        ids = sorted(set(label))
        s = {c: sum(np.asarray(x[i]) for i in range(len(x)) if label[i] == c) for c in ids}
        n = {c: label.count(c) for c in ids}
        w = {(a, b): round(float(s[a] @ s[b]) - offset * n[a] * n[b], 9) for a, b in itertools.permutations(ids, 2)}
        edges = {}
        for a in ids:
            j = min((b for b in ids if b != a), key=lambda b: (-w[a, b], b), default=None)
            if j is not None and w[a, j] > 0:
                edges[min(a, j), max(a, j)] = w[a, j]
        taken, to = set(), {}
        for (a, b), _ in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
            if not {a, b} & taken:
                taken |= {a, b}
                to[b] = a
        if not to:
            return label
        label = [to.get(c, c) for c in label]


def test_rounds_three_ways(spark):
    x = np.random.default_rng(7).uniform(-1, 1, (40, 6))
    p, want = problem(spark, x, 0.3), literal_rounds(x, 0.3)
    here, spread, edges = rounds.parallel_gaec(p), rounds.parallel_gaec(p, small=0), rounds.parallel_by_edges(p)
    for found in (here, spread, edges):
        assert labels_of(found.labels) == want
    assert here.rounds == spread.rounds == edges.rounds
    assert labels_of(rounds.parallel_gaec(Problem(p.nodes.repartition(5), 0.3)).labels) == want
    left = objective.cluster_pair_weights(contraction.sums_of(p.nodes, here.labels), 0.3)
    assert pairs.positive(left).isEmpty()
    assert here.cost() <= objective.all_cut_cost(p.nodes, 0.3).first().cost


def literal_lazy(x, offset, k, cap):
    """The lazy rule over an explicit table of weights: matchings within a graph, then a new graph."""
    n = len(x)
    label, rounds = list(range(n)), []

    def weights():
        own = sorted(set(label))
        sums, size = {c: sum(x[i] for i in range(n) if label[i] == c) for c in own}, Counter(label)
        return {(a, b): round(float(sums[a] @ sums[b]) - offset * size[a] * size[b], 9) for a in own for b in own if a < b}

    def best(edges, m):
        near = defaultdict(list)
        for (a, b), w in edges.items():
            near[a].append((-w, b))
            near[b].append((-w, a))
        kept = {(min(i, j), max(i, j)) for i, v in near.items() for _, j in sorted(v)[:m]}
        return {e: w for e, w in edges.items() if e in kept and w > 0}

    while graph := best(weights(), k):
        rounds.append(0)
        while graph:
            first = {i: min((-w, sum(e) - i) for e, w in graph.items() if i in e) for i in {i for e in graph for i in e}}
            to = {b: a for a, b in graph if first[a][1] == b and first[b][1] == a}
            rounds[-1] += len(to)
            label = [to.get(c, c) for c in label]
            ends = {tuple(sorted((to.get(a, a), to.get(b, b)))) for a, b in graph}
            w = weights()
            graph = best({e: w[e] for e in ends if e[0] != e[1] and w[e] > 0}, cap)
    return label, rounds


@pytest.mark.parametrize("seed,n,d,offset,k,cap", [(9, 60, 6, 0.3, 3, 3), (1, 40, 4, 0.1, 1, 2), (2, 80, 5, 0.4, 5, 1)])
def test_lazy_is_one_rule_at_every_size(spark, seed, n, d, offset, k, cap):
    x = np.random.default_rng(seed).uniform(-1, 1, (n, d))
    p, (want, rounds_) = problem(spark, x, offset), literal_lazy(x, offset, k, cap)
    assert sum(rounds_) == n - len(set(want)) > 5
    for options in ({}, {"small_nodes": 0}, {"small_nodes": n // 2}, {"index": neighbours.Index("ivf", 4, 4), "later": "faiss_brute_force"}):
        found = lazy.dense_laec(p, k, cap, **options)
        assert labels_of(found.labels) == want and found.rounds == rounds_, options
    assert found.cost() == pytest.approx(cost(x, offset, want)) and found.cost() < cost(x, offset, range(n))
    near = lazy.dense_laec(p, k, cap, index="IVF4,Flat", later="faiss_brute_force")
    left = objective.cluster_pair_weights(contraction.sums_of(p.nodes, near.labels), offset)
    assert left.where("w > 1e-9").isEmpty()


def test_objective_fast_and_literal(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(25, 5))
    label = rng.integers(0, 4, 25).tolist()
    p = problem(spark, x, 0.7)
    labels = spark.createDataFrame(list(enumerate(label)), "node_id long, cluster long")
    want = cost(x, 0.7, label)
    assert objective.labeling_cost(p.nodes, labels, 0.7).first().cost == pytest.approx(want)
    assert objective.labeling_cost_by_pairs(p.nodes, labels, 0.7).first().cost == pytest.approx(want)
    sums = {(r.a, r.b): r.w for r in objective.cluster_pair_weights(contraction.sums_of(p.nodes, labels), 0.7).collect()}
    edges = {(r.a, r.b): r.w for r in pairs.contract_edges(pairs.pair_weights(p.nodes, 0.7), labels).collect()}
    assert sums.keys() == edges.keys() and all(sums[k] == pytest.approx(edges[k]) for k in sums)


def test_searches_agree(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8))
    x[60:70] = x[:10]  # ties
    clusters = problem(spark, x, 0.1).clusters()
    want = {i: [(-w, j) for w, j in sorted((-round(float(x[i] @ x[j]) - 0.1, 9), j) for j in range(120) if j != i)[:6]] for i in range(120)}

    def got(df):
        out = {}
        for r in df.orderBy("i", "rank").collect():
            out.setdefault(r.i, []).append((r.w, r.j))
        return out

    assert got(neighbours.by_expression(clusters, clusters, 6, 0.1, 9)) == want
    assert {i: [j for _, j in v] for i, v in got(neighbours.by_blocks(clusters, clusters, 6, 0.1, block_rows=17, places=9)).items()} == {i: [j for _, j in v] for i, v in want.items()}
    one = neighbours.one_nearest(clusters, 5, 0.1, 6).orderBy("rank").collect()
    assert [r.j for r in one] == [j for _, j in want[5]]
    exact = {i: {j for _, j in v} for i, v in want.items()}
    near = got(neighbours.nearest(clusters, 6, 0.1, neighbours.Index("ivf", 8, 4)))
    assert np.mean([len(exact[i] & {j for _, j in near.get(i, [])}) / 6 for i in range(120)]) > 0.6
    full = got(neighbours.by_cells(clusters, clusters, 6, 0.1, neighbours.Index("ivf", 8, 8), block_rows=11))
    assert all({j for _, j in full[i]} == exact[i] for i in range(120) if len({w for w, _ in want[i]}) == 6)


def test_recall_of_registered_indices(spark):
    at = "/root/testdata/sf0.1"
    exact = {(r.i, r.j) for r in queries.knn5(spark, at).select("i", "j").collect()}
    clusters = Problem.from_table(spark.read.parquet(f"{at}/embeddings.parquet"), queries.OFFSET).clusters()
    for found in (queries.knn_ivf(spark, at), neighbours.nearest(clusters, 5, queries.OFFSET, neighbours.parse_index("HNSW"))):
        recall = len(exact & {(r.i, r.j) for r in found.select("i", "j").collect()}) / len(exact)
        print(f"recall {recall:.4f}")
        assert recall >= 0.9


def test_greedy_matching(spark):
    rng = np.random.default_rng(6)
    edges = list({(int(min(a, b)), int(max(a, b))): float(w) for a, b, w in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(1, 12, 150)) if a != b}.items())
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges], "a long, b long, w double")
    want = sorted(matching.match_here([(w, a, b) for (a, b), w in edges]))
    taken = set()
    for (a, b), w in sorted(edges, key=lambda e: (-e[1], e[0])):
        if not {a, b} & taken:
            taken |= {a, b}
            assert (a, b, w) in want
    for small in (0, 20, 1000):
        assert sorted(map(tuple, matching.greedy_matching(df, keeper(spark, "t"), "m", small).collect())) == want


def test_neighbour_lists(spark):
    lists = spark.createDataFrame([(0, 2, 5.0), (0, 3, 4.0), (0, 1, 3.0), (1, 2, 2.0), (1, 4, 1.0), (5, 2, 9.0)], "i long, j long, w double")
    asked = spark.createDataFrame([(0, 1), (5, 0), (7, 8)], "x long, y long")
    assert sorted(map(tuple, pairs.common_neighbours(lists, asked).collect())) == [(0, 1, 2, 7.0), (5, 0, 2, 14.0)]
    assert sorted(map(tuple, pairs.exclusive_neighbours(lists, asked).collect())) == [(0, 1, 0, 3, 4.0), (0, 1, 1, 4, 1.0), (5, 0, 0, 1, 3.0), (5, 0, 0, 3, 4.0)]
    assert {r.node_id: (r.followers, r.max_w) for r in pairs.inverse_neighbours(lists).collect()} == {1: (1, 3.0), 2: (3, 9.0), 3: (1, 4.0), 4: (1, 1.0)}
    assert {r.i: r.min_w for r in pairs.least_weight(lists).collect()} == {0: 3.0, 1: 1.0, 5: 9.0}


def test_labels(spark):
    labels = spark.createDataFrame([(0, 90), (1, 7), (2, 90), (3, -4)], "node_id long, cluster long")
    assert {r.node_id: r.label for r in pairs.contiguous(labels, keeper(spark, "t")).collect()} == {0: 2, 1: 1, 2: 2, 3: 0}
    assert labels_of(contraction.canonical(labels)) == [0, 1, 0, 3]
    assert pairs.contiguous(labels.limit(0), keeper(spark, "t")).count() == 0
    asked = spark.createDataFrame([(0, 2), (0, 1)], "a long, b long")
    assert {(r.a, r.b): r.same for r in contraction.connected(labels, asked).collect()} == {(0, 2): True, (0, 1): False}


def test_offset_dimension(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "x array<double>, y array<double>")
    row = df.select(vectors.with_offset("x", 4.0).alias("x"), vectors.with_offset("y", 4.0).alias("y")).select(vectors.signed_inner("x", "y", True).alias("t"), vectors.signed_inner("x", "y", False).alias("p")).first()
    assert (row.t, row.p) == (1.0 - 4.0, 1.0 + 4.0)
    with pytest.raises(ValueError):
        vectors.with_offset("x", -1.0)


def test_text_files(spark, tmp_path, capsys):
    path = tmp_path / "p.txt"
    path.write_text(f"{HEADER}\n0.5\n4 2\n1 0\n1 0\n0 1\n0 1\n")
    p = Problem.from_text(spark, str(path))
    assert p.offset == 0.5 and [list(r.features) for r in p.nodes.orderBy("node_id").collect()] == [[1, 0], [1, 0], [0, 1], [0, 1]]
    assert Problem.from_text(spark, str(path), 0.25).offset == 0.25
    from cohesio import cli

    said = cli.main(["-f", str(path), "-i", "brute_force", "-s", "gaec", "-o", str(tmp_path / "out"), "-d"])
    assert said["clusters"] == 2 and said["objective"] == -2.0 and "objective: -2" in capsys.readouterr().out
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["0", "0", "2", "2"]
    assert cli.main(["-f", str(path), "-i", "HNSW", "-s", "dense_laec_bf_later", "-t", "0"])["clusters"] == 2
    write_labels(p.nodes.select("node_id", F.lit(3).alias("cluster")), str(tmp_path / "out2"))
    for bad in ("WRONG\n0\n1 1\n1\n", f"{HEADER}\n0\n2 2\n1 2 3\n", f"{HEADER}\n0\n2 2\n1 2 3 4 5\n", f"{HEADER}\n0\n", f"{HEADER}\n-1\n1 1\n1\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            Problem.from_text(spark, str(path))
    path.write_text(f"{HEADER}\n0\n0 3\n")
    assert Problem.from_text(spark, str(path)).nodes.count() == 0


def test_choices(spark):
    for solver, index, precision in (("laec_bf_later", "HNSW", "single"), ("gaec", "Flat", "single"), ("dense_laec_bf_later", "brute_force", "single"), ("dense_gaec", "Flat", "double"), ("gaec", "what", "single")):
        with pytest.raises(ValueError):
            api.check_choice(solver, index, precision)
    assert neighbours.parse_index("Flat").exact and neighbours.parse_index("faiss_brute_force").exact and not neighbours.parse_index("HNSW32").exact
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        Problem.from_table(rows).checked()
    with pytest.raises(ValueError):
        Problem.from_table(rows, -1.0)
    with pytest.raises(ValueError):
        Problem.from_flat(spark, [1.0, 2.0, 3.0], 2, 2)


def test_entry_points(spark):
    x = np.random.default_rng(8).uniform(-1, 1, (20, 4)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = greedy(x.astype(float), 0.2)
    assert api.dense_multicut_flat(spark, x.reshape(-1), 20, 4, 0.2, 5, "brute_force", "gaec", 5) == want
    assert labels_of(api.dense_multicut(df, 0.2, 5, "Flat", "dense_gaec", 5)) == want
    assert labels_of(api.dense_multicut_double(df, 0.2, 5, "brute_force", "dense_gaec_inc", 5)) == want
    for solver in ("dense_laec", "parallel_gaec"):
        assert api.dense_multicut(df, 0.2, 5, "faiss_brute_force", solver, 5).count() == 20


@pytest.mark.parametrize("solver", ["gaec", "dense_gaec", "dense_gaec_inc", "parallel_gaec", "dense_laec"])
def test_no_nodes(spark, solver):
    p = Problem.from_flat(spark, [], 0, 3, 0.1)
    assert api.solve(p, solver).labels.count() == 0
