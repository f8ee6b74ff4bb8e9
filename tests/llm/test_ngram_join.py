import random

import numpy as np
import pytest

from cohesio.llm import components, ngram_join, shared

SCHEMA = "doc_id long, text string, class_id string, node long"


def store(spark):
    return shared.Tables(spark, "t")


def brute(rows, size=5, threshold=0.8):
    """class, links and copies of each doc_id, from all pairs."""
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset([i])
    kinds = list(dict.fromkeys(sets.values()))
    near = {s: [o for o in kinds if o is not s and len(s & o) >= threshold * len(s | o)] for s in kinds}
    label = {}
    for s in kinds:
        if s not in label:
            todo, label[s] = [s], s
            while todo:
                for o in near[todo.pop()]:
                    if o not in label:
                        label[o] = s
                        todo.append(o)
    least = {}
    for i, s in sets.items():
        least[label[s]] = min(i, least.get(label[s], i))
    return {i: (least[label[s]], len(near[s]), sum(o == s for o in sets.values())) for i, s in sets.items()}


def corpus(seed, groups=12, common=True):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage, out = " ".join(word() for _ in range(40)), []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy) + (" " + passage if common and rng.random() < 0.3 else ""))
    out += ["", None, "one", "one", "one two three", "a b c d e", "a b c d e", "a b c d e f", out[0], out[0], "z " * 5000, " z\t" * 7000]
    return [(k, t, "c", 1) for k, t in enumerate(out)]


@pytest.mark.parametrize("options", [{}, {"small": 4, "bucket_block": 3, "block": 3}])
def test_join_matches_brute_force(spark, options):
    rows = corpus(len(options))
    got = ngram_join.join(spark.createDataFrame([*rows, (None, "null id", "c", 1)], SCHEMA), store(spark), **options).collect()
    found = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got}
    assert found.pop(None) == (None, 0, 1) and found == brute(rows) and len(got) == len(rows) + 1
    assert all(r.is_first == (r.class_id == r.doc_id) for r in got)


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (2, "other words here to see now", "x", 1), (2, "two texts of one id as well", "x", 1)]
    got = ngram_join.join(spark.createDataFrame(rows, SCHEMA), store(spark)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == [(1, 1, 0, 2), (1, 1, 0, 2), (2, 2, 0, 1), (2, 2, 0, 1)]
    assert ngram_join.join(spark.createDataFrame([], SCHEMA), store(spark)).count() == 0


def test_half_in_one_group_and_half_empty(spark):
    """One group of near copies holds half of the rows, a third of them exact copies; the other half has no words."""
    words = [f"w{k}" for k in range(120)]
    near = lambda k: " ".join(w if j != k % 40 else f"x{k}" for j, w in enumerate(words))
    rows = [(k, near(0) if k % 3 == 0 else near(k), "c", 1) for k in range(300)] + [(1000 + k, (None, "", " \n")[k % 3], "c", 1) for k in range(300)]
    rows += [(None, near(7), "c", 1), (None, near(7), "c", 1), (None, "an unrelated text of no id at all", "c", 1)]
    got = ngram_join.join(spark.createDataFrame(rows, SCHEMA), store(spark), block=32, bucket_block=16).collect()
    want = brute([(k if r[0] is None else r[0], *r[1:]) for k, r in enumerate(rows, 10**9)])
    null = [r for r in got if r.doc_id is None]
    found = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got if r.doc_id is not None}
    assert len(got) == len(rows) and found == {k: v for k, v in want.items() if k < 10**9}
    assert sorted((r.class_id, r.n_links, r.n_copies) for r in null if r.class_id is not None) == [want[10**9 + 600]] * 2
    assert [(r.class_id, r.n_links, r.n_copies, r.is_first) for r in null if r.class_id is None] == [(None, 0, 1, True)]
    assert sum(r.is_first for r in got) == 302 and [r.doc_id for r in got if r.is_first and r.doc_id is not None and r.doc_id < 1000] == [0]


def test_overlaps_and_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) if i != j else -1 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    got = ngram_join.overlaps(sets)
    np.fill_diagonal(got, -1)
    assert (got == want).all()


def test_a_pair_at_the_threshold_meets_often_enough():
    """The recall promised for a bucket of the last level, over many pairs of sets of similarity 0.8."""
    rng = np.random.default_rng(2)
    runs, met = ngram_join.runs_needed(0.8, 0.99, 3), 0
    for _ in range(200):
        common = rng.integers(0, 2**63, 160).astype(np.uint64)
        pair = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 20).astype(np.uint64)])) for _ in range(2)]
        sigs = np.stack([ngram_join.signature(s) for s in pair])
        found = [set(), set()]
        for start in ngram_join.mixed(np.arange(1, runs + 1, dtype=np.uint64)):
            row, path = np.arange(2), np.full(2, start, dtype=np.uint64)
            for _ in range(3):
                kept, path = ngram_join.children(path, sigs[row], 0.8)
                row = row[kept]
            for r, p in zip(row.tolist(), path.tolist()):
                found[r].add(p)
        met += bool(found[0] & found[1])
    assert met >= 190


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 200), (300, 200), (5, 5), (400, 401), (401, 400)]
    got = components.connected(spark.createDataFrame(chain, "u long, v long"), store(spark), "c").collect()
    want = {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100, 400: 400, 401: 400}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
