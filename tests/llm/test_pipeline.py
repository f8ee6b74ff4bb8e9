import random
from collections import Counter

import corpus_pipeline
from cohesio.llm import queries
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_quality import brute as measures

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 300))) for _ in range(60)]
    texts += [texts[0], texts[1] + " tail", texts[2].replace(" ", "  ", 3), "too short", "", None, "one two three " * 50, texts[3] + " mail me.now@host.example.com or 10.1.2.3"]
    texts += [" ".join(word() for _ in range(4000)), texts[4] + "\n" + texts[4]]
    return [(k, t, "en", f"s{k % 4}" if k % 7 else "hot", len(t) if t is not None else None) for k, t in enumerate(texts)]


def test_stages_match_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "PII", "best-fit packing"]

    first = stages["quality rules"](spark, docs, "")
    want = [r for r in rows if (m := measures(r[1]))[0] >= 50 and 100 * m[5] <= 50 * m[0]]
    assert first.columns == docs.columns and sorted(map(tuple, first.collect())) == sorted(want)

    second = stages["n-gram Jaccard join"](spark, spark.createDataFrame(want, SCHEMA), "")
    label = groups(want)
    want = [r for r in want if label[r[0]][0] == r[0]]
    assert second.columns == docs.columns and sorted(map(tuple, second.collect())) == sorted(want)

    third = stages["PII"](spark, spark.createDataFrame(want, SCHEMA), "")
    got = {r.doc_id: r for r in third.collect()}
    assert third.columns == docs.columns and len(got) == len(want)
    for doc_id, text, *_ in want:
        assert (got[doc_id].text == text) == ("@" not in text) and got[doc_id].n_chars == len(got[doc_id].text)

    last = stages["best-fit packing"](spark, third, "").collect()
    parts = Counter()
    for r in last:
        parts[r.doc_id] += r.length
    assert parts == {i: len(r.text.encode()) + 1 for i, r in got.items()}
    fill = Counter()
    for r in last:
        fill[r.bin_id] += r.length
    assert max(fill.values()) <= 8192


def test_clashing_columns_and_nulls(spark):
    extra = ", _id long, _hash long, n_entities long, node long, host string, class_id string, `a b` string"
    rows = [(*r, k, k, 5, k, "h", "c", "x") for k, r in enumerate(documents()[:12])] + [(None, None, None, None, None) + (None,) * 7, (None, "word " * 20 + " ".join(f"w{k}" for k in range(90)), None, None, None) + (None,) * 7]
    docs = spark.createDataFrame(rows, SCHEMA + extra)
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() >= 12
    assert corpus_pipeline.STAGES[3][1](spark, docs, "").count() >= 14


def test_near_duplicates_decide_by_row(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(90))
    a, z, y, n = text(), text(), text(), text()
    rows = [(3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, z, "en", "s", 1), (7, z + " more", "en", "s", 1), (9, y, "en", "s", 1), (9, y, "en", "s", 1), (9, y, "en", "r", 1)]
    rows += [(None, n, None, None, None), (None, n, None, None, None), (None, n + " more", None, None, None), (None, text(), None, None, None), (2, None, "en", "s", 1), (2, None, "en", "s", 1)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    ids = lambda want: sorted(r.doc_id for r in found if r.text == want)
    found = got.collect()
    assert (ids(a), ids(z), ids(y)) == ([3], [5], [9]) and [r.source for r in found if r.text == y] == ["r"]
    assert sum((r.text or "").startswith(n) for r in found) == 1 and len(found) == 7 and sum(r.text is None for r in found) == 2


def test_run_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 40
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_queries_run_on_whole_tables(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_secrets", "op2_best_fit_packing", "op3_token_counts", "op4_sentence_pieces", "op7_token_ids", "op8_ngram_join", "op9_pii", "op10_quality_rules"):
        got = {r.doc_id for r in queries.QUERIES[name](spark, str(tmp_path)).select("doc_id").collect()}
        want = {r[0] for r in rows if r[1] or name != "op3_token_counts"}
        assert got == want, name
