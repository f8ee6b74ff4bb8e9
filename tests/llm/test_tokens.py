import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohesio.llm import byte_bpe, sentence_pieces, shared, token_counts

TEXTS = [None, "", "\n", "one line", "two\nlines\n", "a\n\n\nb", "é\n日本 x\n🎉🎉\n\n  end", "word " * 2000 + "\n" + "other " * 100, " \n \n", "no end\r\nx"]


def brute(text, sections):
    """Tokens by the library's own offsets, each to the section with most of its bytes."""
    encoder = byte_bpe.load()
    out = np.zeros(len(sections) + 1, dtype=int)
    raw, at = (text or "").encode(), 0
    edge = [len(text[:k].encode()) for k in range(len(text or "") + 1)] if text else [0]
    for i in encoder.whole.encode(text or "", add_special_tokens=False).ids:
        n = int(encoder.n_bytes[i])
        common = [max(0, min(at + n, edge[e]) - max(at, edge[s])) for s, e in sections]
        best = int(np.argmax(common)) if common and max(common) else -1
        out[best + 1] += 1
        at += n
    assert at == len(raw)
    return out


def lines(text):
    out, at = [], 0
    for x in (text or "").split("\n")[:-1]:
        out.append((at, at + len(x) + 1))
        at = out[-1][1]
    return out + ([(at, len(text))] if text and at < len(text) else [])


def test_counts_by_lines(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "one line", "x")], "doc_id long, text string, section string")
    got = token_counts.counts(docs).collect()
    for k, text in enumerate(TEXTS):
        own = sorted((r.section, r.start, r.end, r.n_tokens) for r in got if r.doc_id == k)
        want = brute(text, lines(text))
        assert want[0] == 0
        assert own == sorted([(n, a, b, int(want[n + 1])) for n, (a, b) in enumerate(lines(text))] * (2 if k == 3 else 1)), text
    assert [(r.section, r.n_tokens) for r in got if r.doc_id is None] == [(0, int(brute("null id", lines("null id"))[1]))]
    assert token_counts.counts(docs.limit(0)).count() == 0


def test_counts_by_given_sections(spark):
    text = "Title here\n\nBody text 日本, more."
    given_ = [(0, 5), (5, 12), (14, 20)]
    docs = spark.createDataFrame([(1, text, given_), (2, text, []), (3, text, None), (4, None, None)], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.counts(docs, "parts").collect()}
    want = brute(text, given_)
    assert [got.get((1, n - 1), 0) for n in range(4)] == want.tolist()
    assert got[2, -1] == got[3, -1] == want.sum() and not any(k[0] == 4 for k in got)


def test_sentence_pieces_match_the_library(spark):
    rng = np.random.default_rng(1)
    words = ["word", "日本", "a", "b!", "\n", "  ", "🎉", "longish", "x=1"]
    giant = " ".join(rng.choice(words, 9000)) + "y" * 30_000 + " end " * 3000
    texts = [*TEXTS, giant, " lead", "trail ", "▁mark▁", "<s> </s> <0x41>"]
    docs = spark.createDataFrame([(k, t, b"") for k, t in enumerate(texts)] + [(10, giant, b"")], "doc_id long, text string, ids binary")
    store = shared.Tables(spark, "t")
    encoded = sentence_pieces.encode(docs, store, giant=5000, chunk=700)
    library = sentence_pieces.load().library
    got = sentence_pieces.decode(encoded).collect()
    assert len(got) == len(texts) + 1 and max(r.n_chunks for r in got) > 20
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.text == library.decode(ids)
        if "▁" not in (texts[r.doc_id] or ""):
            assert r.text == (texts[r.doc_id] or "")
    assert sentence_pieces.encode(docs.limit(0), store).count() == 0 == sentence_pieces.encode(docs.limit(0), store, unigram=True).count()


def unigram(path, fallback=False):
    """A small hand-made unigram model; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec, kinds = pb.ModelProto(), pb.ModelProto.SentencePiece
    for piece, score, kind in [("<unk>", 0, kinds.UNKNOWN), ("<s>", 0, kinds.CONTROL), ("</s>", 0, kinds.CONTROL)]:
        spec.pieces.add(piece=piece, score=score, type=kind)
    if fallback:
        for b in range(256):
            spec.pieces.add(piece=f"<0x{b:02X}>", score=0, type=kinds.BYTE)
    rng = np.random.default_rng(5)
    for piece in sorted({"▁", "a", "b", "c", "ab", "abc", "bc", "ca", "cab", "▁a", "▁ab", "b▁", "aa", "aaa", "abcab", "cc", "▁▁"}):
        spec.pieces.add(piece=piece, score=float(-2 * len(piece) ** 0.7 - rng.random()), type=kinds.NORMAL)
    spec.trainer_spec.model_type = spec.trainer_spec.UNIGRAM
    spec.trainer_spec.byte_fallback = fallback
    spec.trainer_spec.unk_surface = " ⁇ "
    spec.normalizer_spec.name = "identity"
    spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.escape_whitespaces = True, False, True
    path.write_bytes(spec.SerializeToString())
    return str(path)


def test_unigram_scan_matches_the_library(spark, tmp_path):
    for fallback in (False, True):
        path = unigram(tmp_path / f"u{fallback}.model", fallback)
        rng = np.random.default_rng(3)
        texts = ["".join(rng.choice(list("abc "), 400)) for _ in range(4)] + ["".join(rng.choice(list("abcéz "), 300)), "a" * 333, "zz" * 100, ""]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r for r in sentence_pieces.encode(docs, shared.Tables(spark, "t"), path, giant=50, chunk=23).collect()}
        library = sentence_pieces.load(path).library
        for k, t in enumerate(texts):
            assert np.frombuffer(got[k].ids, "<u4").tolist() == library.encode(t), t
            assert sentence_pieces.load(path).decode(got[k].ids) == library.decode(library.encode(t))
        assert max(r.n_chunks for r in got.values()) > 10


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=9, max_size=9), min_size=1, max_size=5))
def test_max_plus_is_associative(flat):
    ms = [np.array(x, dtype=float).reshape(3, 3) for x in flat]
    left, right = ms[0], ms[-1]
    for m in ms[1:]:
        left = sentence_pieces.max_plus(left, m)
    for m in ms[-2::-1]:
        right = sentence_pieces.max_plus(m, right)
    assert (left == right).all()
    first = np.array([0.0, -np.inf, -np.inf])
    for k, f in enumerate(sentence_pieces.prefixes([*ms, ms[0]], first)):
        whole = [first, *(sentence_pieces.stepped(first, m) for m in [left])]
        assert k < len(ms) or (f == whole[1]).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=4), min_size=1, max_size=7), st.integers(0, 3))
def test_exits_compose(flat, last):
    cs = [np.array(c) for c in flat]
    found = sentence_pieces.exits(cs, last)
    assert found[-1] == last and all(cs[k + 1][found[k + 1]] == found[k] for k in range(len(cs) - 1))
    assert sentence_pieces.composed(cs)[last] == cs[0][found[0]]


def test_made_unigram_model_matches_the_library(spark, monkeypatch):
    """The pieces at hand, giants with and without blanks, groups of few chunks, exact ties."""
    monkeypatch.setattr(sentence_pieces, "GROUP", 3)
    rng = np.random.default_rng(8)
    words = ["the", "word", "日本", "a", "ing", "\n", "  ", "🎉", "longish", "=1", "ab", "tion", "é"]
    giants = [sep.join(rng.choice(words, 6000)) for sep in (" ", "")] + ["a" * 9000, "ab" * 5000, "🎉" * 3000, "x y" * 4000, "\u0378" * 4001]
    texts = [*TEXTS, *giants]
    docs = spark.createDataFrame([*enumerate(texts), (None, giants[1])], "doc_id long, text string")
    rows = sentence_pieces.decode(sentence_pieces.encode(docs, shared.Tables(spark, "t"), unigram=True, giant=3000, chunk=500), unigram=True).collect()
    library = sentence_pieces.load(unigram=True).library
    assert len(rows) == len(texts) + 1 and sum(r.n_chunks > 5 for r in rows) == len(giants) + 1
    for r in rows:
        text = giants[1] if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.text == library.decode(ids) == (text.replace("▁", " ") if "▁" in text else text), text[:40]


def test_transfer_of_coupled_entries_is_exact():
    m = sentence_pieces.load(unigram=True)
    rng = np.random.default_rng(2)
    text = m.library.normalize(" ".join(rng.choice(["the", "cat", "日本", "aaaa", "ing", "🎉"], 200)))
    got = m.transfer(text, 400)
    for i in range(m.longest):
        want = m.paths(text, 400, np.where(np.arange(m.longest) == i, 0.0, -np.inf))[0][400 : 400 + m.longest]
        assert got[i].tolist() == want
