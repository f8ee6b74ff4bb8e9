import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohesio.llm import byte_bpe, ranges, shared, token_files, warc

PAGES = "page_id long, url string, html string, refers_to string"


def test_warc_round_trip(spark):
    big = "x" * 150 + "é"
    rows = [(3, "http://a", big, "clash"), (1, None, big, None), (2, "u r l", None, None), (4, "b", "small", None), (5, "b", "small", None), (5, "b", big, None), (6, "c", "y" * 100, None), (7, "c", "y" * 100, None), (8, "c", "z" * 99, None), (9, "c", "z" * 99, None), (None, "n", "n", None), (None, "n", big, None), (None, "o", "w" * 100, None), (None, "o", "w" * 100, None)]
    got = warc.read(warc.write(spark.createDataFrame(rows, PAGES), shared.work_dir(spark, "t"), roll_bytes=600)).collect()
    assert len(got) == len(rows) and {r.url for r in got if r.page_id == 2} == {"u%20r%20l"}
    for row in got:
        html = next(h or "" for p, _, h, _ in rows if p == row.page_id and hashlib.sha256((h or "").encode()).hexdigest() == row.payload_digest)
        assert row.payload_bytes == len(html.encode())
        assert (row.html is None) == (row.record_type == "revisit")
        if row.html is not None:
            assert row.html == html
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in got}
    assert kinds == {(None, 1): ("response", None), (None, 152): ("revisit", 1), (None, 100): ("response", None), (1, 152): ("response", None), (3, 152): ("revisit", 1), (5, 152): ("revisit", 1), (2, 0): ("response", None), (4, 5): ("response", None), (5, 5): ("response", None), (6, 100): ("response", None), (7, 100): ("revisit", 6), (8, 99): ("response", None), (9, 99): ("response", None)}


def test_warc_is_deterministic_and_notices_damage(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "text " * k, None) for k in range(60)], PAGES)
    a, b = (warc.write(pages.repartition(n), shared.work_dir(spark, "t"), roll_bytes=2000).orderBy("unit", "roll").collect() for n in (1, 5))
    assert [(x.path.rpartition("/")[2], x.n_records, x.sha256) for x in a] == [(x.path.rpartition("/")[2], x.n_records, x.sha256) for x in b]
    data = shared.read_bytes(a[0].path)
    assert hashlib.sha256(data).hexdigest() == a[0].sha256 and len(list(warc.records(data))) == a[0].n_records + 1
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(data[:-9]))


def test_files_do_not_depend_on_the_partitioning(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = spark.range(40_000).selectExpr("if(id % 3 = 0, 7, id * 7919 % 100003) page_id", "concat('http://h/', id) url", "if(id % 3 = 0 and id % 2 = 0, 'the same page', repeat(concat('text ', id % 500), 1 + int(id % 7))) html", "cast(id as string) refers_to")
        found = []
        for n in (1, 7):
            manifest = warc.write(pages.repartition(n), shared.work_dir(spark, "t"), unit_bytes=1 << 20).orderBy("unit", "roll").collect()
            found.append([(x.path.rpartition("/")[2], x.n_records, x.sha256) for x in manifest])
        assert found[0] == found[1] and len(found[0]) > 20 and sum(x[1] for x in found[0]) == 40_000
        assert max(x[1] for x in found[0]) < 12_000  # page 7 has a third of all rows, a half of them alike
        ids = [f["WARC-Record-ID"] for x in manifest for f, _ in warc.records(shared.read_bytes(x.path)) if f["WARC-Type"] != "warcinfo"]
        assert len(ids) == len(set(ids)) == 40_000
        docs = pages.selectExpr("page_id doc_id", "html text")
        files = [token_files.write(docs.repartition(n), shared.work_dir(spark, "t"), file_bytes=1 << 20).orderBy("file").collect() for n in (2, 9)]
        same = [[(x.file, x.n_docs, x.n_ids, x.start, hashlib.sha256(shared.read_bytes(x.path)).hexdigest()) for x in some] for some in files]
        assert same[0] == same[1] and len(same[0]) > 3 and sum(x[1] for x in same[0]) == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cuts(spark):
    rows = [(k, 10) for k in range(100)] + [(50, 10)] * 40 + [(None, 10)] * 25
    weights = spark.createDataFrame(rows, "key long, weight long").repartition(5)
    cuts = ranges.cut(weights, shared.Tables(spark, "t"), "x", 100)
    assert cuts.parts[-1] == 3 and max(cuts.parts[:-1]) == 4 and cuts.starts == sorted(cuts.starts) and cuts.starts[0] == 0
    got = weights.select("key", cuts.shard(F.col("key")).alias("s"), cuts.unit(F.col("key"), F.xxhash64(F.rand(1))).alias("u")).collect()
    assert all(r.s == (len(cuts.starts) if r.key is None else max(k for k, x in enumerate(cuts.starts) if x <= r.key)) for r in got)
    assert {r.u for r in got if r.key == 50} <= set(range(4, 10)) and max(r.u for r in got) == cuts.units - 1
    assert ranges.cut(weights.limit(0), shared.Tables(spark, "t"), "x", 100).units == 1


def test_warc_of_nothing(spark):
    assert warc.read(warc.write(spark.createDataFrame([], PAGES), shared.work_dir(spark, "t"))).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n, most in ((0, 2), (1, 2), (5, 300), (1000, 70_000), (999, 2**32)):
        ids = rng.integers(0, most, n).astype("<u4")
        cut = sorted(rng.integers(0, n + 1, 3).tolist())
        parts = [x.tobytes() for x in np.split(ids, cut)]
        got = list(token_files.unpack_blocks(token_files.pack_block([7, 8, 9, 10], parts) * 2))
        assert len(got) == 2
        for doc_ids, counts, back in got:
            assert doc_ids.tolist() == [7, 8, 9, 10] and counts.tolist() == [len(p) // 4 for p in parts] and back.tolist() == ids.tolist()


def test_encoder_matches_the_library():
    encoder = byte_bpe.load()
    texts = ["", " ", "a", " a", "a ", "a  b", "a   b ", "a\n b", "a \n b", "it's  it's", "é 日本 🎉", "x<|endoftext|> y", "　 b", "a  b", "tab\t b", "1 22 333 !! ??", "a" * 5000, "word " * 3000]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids, repr(text)
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "'s", "é", "x9", "!", "　", "日本", "\r", ".", "The", " \n"]), max_size=25).map("".join))
    def same(text):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids

    same()


def test_tables_that_turn_over_keep_ids():
    from cohesio.llm import sentence_pieces

    words = [f"w{k * 7919 % 613}{'.' if k % 3 else ''}{'s' * (k % 5)}" for k in range(4000)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, 4000, 20)] + ["", " a", "a  b", "▁ a"]
    bpe, pieces = byte_bpe.ByteBPE(byte_bpe.default_path()), sentence_pieces.load()
    bpe.kept.most = pieces.kept.most = 100
    for lo in range(0, len(texts), 10):
        some = texts[lo : lo + 10]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(some)] == [x.ids for x in bpe.whole.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in pieces.encode(some)] == pieces.library.encode(some)
    assert bpe.kept.old.number and pieces.kept.old.number
    pieces.kept.most = sentence_pieces.MOST


def test_token_files(spark):
    rows = [(5, "hello world", "x"), (1, None, "y"), (2, "", "z"), (9, "the end. " * 4000, "w"), (3, "hello world", "x"), (9, "an earlier text", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = token_files.read(token_files.write(docs, shared.work_dir(spark, "t"), block_ids=50)).orderBy("doc_id", "start").collect()
    at, encoder = 0, byte_bpe.load().whole
    null = token_files.read(token_files.write(docs.unionByName(docs.limit(2).selectExpr("cast(null as long) doc_id", "text", "start")), shared.work_dir(spark, "t"))).collect()
    assert len(null) == 8 and sorted(r.start for r in null if r.doc_id is None)[0] == sum(r.n_tokens for r in null if r.doc_id is not None)
    for row, (doc_id, text, _) in zip(got, sorted(rows), strict=True):
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read(token_files.write(docs.limit(0), shared.work_dir(spark, "t"))).count() == 0
