from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohesio.llm import packing


def slow(items, capacity):
    """Best fit by looking at every bin."""
    bins = []
    for item, (length, source, cluster) in enumerate(items):
        start = 0
        while length - start > capacity:
            bins.append({"room": 0, "s": set(), "c": set(), "has": [(item, start, capacity)]})
            start += capacity
        rest = length - start
        fit = [b for b in bins if b["room"] >= rest and b["room"] > 0 and source not in b["s"] and cluster not in b["c"]]
        best = min(fit, key=lambda b: (b["room"], bins.index(b)), default=None)
        if best is None:
            best = {"room": capacity, "s": set(), "c": set(), "has": []}
            bins.append(best)
        best["has"].append((item, start, rest))
        best["room"] -= rest
        best["s"] |= {source} - {None}
        best["c"] |= {cluster} - {None}
    return [b["has"] for b in bins]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 35), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 5))), max_size=40))
def test_pack_is_best_fit(items):
    assert packing.pack(items, 12) == slow(items, 12)


def test_packed(spark):
    rows = [(k, "x" * (k * 37 % 900), f"s{k % 3}" if k % 5 else "hot", k) for k in range(600)]
    rows += [(1000, None, None, 1), (1001, "y" * 5000, "a", 2), (1002, "same", "b", 3), (1002, "same", "b", 3), (1003, "same", "c", 4), (None, "z", "d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id long")
    for shard_rows in (50, 10_000):
        got = packing.packed(docs, F.octet_length("text"), F.xxhash64("text"), 1000, shard_rows).collect()
        parts, bins = defaultdict(list), defaultdict(list)
        for r in got:
            parts[r.doc_id].append((r.start, r.length))
            bins[r.bin_id].append(r)
        assert Counter(len(v) for v in parts.values())[5] == 1
        for doc_id in {r[0] for r in rows}:
            want = sum(len(t or "") for i, t, *_ in rows if i == doc_id)
            assert sum(n for _, n in parts[doc_id]) == want
        texts = defaultdict(set)
        for i, t, *_ in rows:
            texts[i].add(t)
        for own in bins.values():
            assert sum(r.length for r in own) <= 1000
            assert sorted(r.place for r in own) == list(range(len(own)))
            sources = [r.source for r in own if r.source is not None]
            assert len(sources) == len(set(sources))
            same = [next(iter(texts[r.doc_id])) for r in own if len(texts[r.doc_id]) == 1]
            same = [t for t in same if t is not None]
            assert len(same) == len(set(same))
    assert packing.packed(docs.limit(0), F.octet_length("text"), F.xxhash64("text")).count() == 0


def test_bins_do_not_depend_on_the_order_of_rows(spark):
    rows = [(k % 50, "x" * (k % 7), f"s{k % 3}", k) for k in range(400)] + [(1, "same", "s1", 0), (1, "same", "s2", 0), (1, "same", None, 0)] + [(None, "hot row", "h", 0)] * 500
    pack = lambda some: sorted(map(str, packing.packed(spark.createDataFrame(some, "doc_id long, text string, source string, x long").repartition(3), F.octet_length("text"), F.xxhash64("text"), 40, 100).collect()))
    first = pack(rows)
    assert first == pack(rows[::-1]) and len(first) == len(rows)
    # The hot row's portions go to several shards.
    hot = Counter(r.bin_id >> 24 for r in packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string, x long"), F.octet_length("text"), F.xxhash64("text"), 40, 100).where("doc_id is null").collect())
    assert len(hot) > 2 and max(hot.values()) <= 4 * packing.PORTION
