"""SentencePiece encoding and decoding, with giant documents split into chunks that are worked on in parallel.

Unigram models, by a max-plus scan: the best segmentation of a text is a path through its characters. A chunk's
transfer matrix T[i, o] has the best score of a path that enters the chunk i characters after its start (where a
piece from the chunk before ends) and leaves it o characters after its end. Matrices combine associatively by max and
plus: in groups of GROUP chunks, then over the groups, then back within each group, so that every chunk has the best
scores of its entries. With these each chunk finds its own best paths and, for each exit, the entry that the best one
comes from; these choices combine in the same two levels from the end, which tells every chunk's exit, and each is
traced back on its own. Any text can be cut, with blanks or without. Of equal scores the longer last piece wins, in
all chunks as in the library.

BPE models merge by rank and have no path scores, so that scan can't give their ids. But where no piece has a
word mark (U+2581) after another character, as is checked when a model is loaded, no merge crosses a blank between
two non-blanks: every path goes through such a boundary, its state is the only one, and chunks cut there
encode to the ids they have in the whole text. A chunk without such a place is as long as it must be. For the same
reason the stretches between such blanks are encoded once each while a worker keeps them (see ``stretches``), and
numpy lays out the ids of all places.

Where no unigram model is at hand, ``as_unigram`` makes one of a BPE model's pieces by a fixed rule and without
training: the piece of rank r, by falling score, scores -ln(r + 2), rounded to eighths. Sums of eighths are exact in
the library's 32-bit floats up to 2^21, so it gives the ids of exact arithmetic on all texts below a giant's length.

Ids equal the library's. Decoding joins what ids stand for, as the library does; texts in which
normalisation changes nothing come back as they were.

Cases: a null or empty text has no ids; a null doc_id stays null; repeated rows come back each; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesio.llm.stretches import Stretches
from cohesio.storage import Tables

MARK = "▁"
#: So many chunks' matrices are multiplied in one task.
GROUP = 256
#: Characters that are encoded together, at least one text.
AT_ONCE = 1_000_000
#: Stretches in each of a worker's two tables.
MOST = 60_000
_loaded: dict[tuple[str, bool], "Model"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def as_unigram(proto: bytes) -> bytes:
    """A unigram model with the pieces of another, scored by their ranks."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(proto)
    normal = sorted((k for k, p in enumerate(spec.pieces) if p.type == spec.SentencePiece.NORMAL), key=lambda k: (-spec.pieces[k].score, k))
    for rank, k in enumerate(normal):
        spec.pieces[k].score = -round(8 * math.log(rank + 2)) / 8
    spec.trainer_spec.model_type = spec.trainer_spec.UNIGRAM
    return spec.SerializeToString()


def load(path: str | None = None, unigram: bool = False) -> "Model":
    """The model of a file, or the unigram model of its pieces."""
    path = path or default_path()
    if (path, unigram) not in _loaded:
        with open(path, "rb") as f:
            proto = f.read()
        _loaded[path, unigram] = Model(as_unigram(proto) if unigram else proto)
    return _loaded[path, unigram]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def stepped(scores: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The scores at a chunk's exits, from those at its entries."""
    return (scores[:, None] + m).max(axis=0)


def prefixes(matrices: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """The scores at the entries of each matrix's chunks, from those of the first."""
    out = [first]
    for m in matrices[:-1]:
        out.append(stepped(out[-1], m))
    return out


def composed(choices: list[np.ndarray]) -> np.ndarray:
    """The first entry of each last exit, from each chunk's entries by exit."""
    at = np.arange(len(choices[0]))
    for c in reversed(choices):
        at = c[at]
    return at


def exits(choices: list[np.ndarray], last: int) -> list[int]:
    """The exit of each chunk on the path that ends at the last one's exit."""
    out = [last]
    for c in reversed(choices[1:]):
        out.append(int(c[out[-1]]))
    return out[::-1]


class Model:
    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(proto)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        kinds = spec.SentencePiece
        self.bpe = spec.trainer_spec.model_type == spec.trainer_spec.BPE
        self.unigram = spec.trainer_spec.model_type == spec.trainer_spec.UNIGRAM and not any(p.type == kinds.USER_DEFINED for p in spec.pieces)
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        plain = not spec.normalizer_spec.precompiled_charsmap and not spec.normalizer_spec.remove_extra_whitespaces
        self.cuts = self.bpe and plain and self.prefix and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        self.pieces = {p.piece: (k, p.score) for k, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.unknown, self.fallback = self.library.unk_id(), spec.trainer_spec.byte_fallback
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - 10.0
        self.longest = max(map(len, self.pieces), default=1)
        self.starts = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.kept = Stretches(MOST)
        surface = spec.trainer_spec.unk_surface.encode()
        self.table = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else surface if p.type == kinds.UNKNOWN else p.piece.replace(MARK, " ").encode() for p in spec.pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        apart = [self.cuts and t[:1] not in ("", " ") and t[-1] != " " and "  " not in t and MARK not in t for t in texts]
        plain = [t for t, a in zip(texts, apart) if a]
        whole = [t for t, a in zip(texts, apart) if not a]
        alone, stretched = (x for lo in range(0, len(whole), 200) for x in self._direct(whole[lo : lo + 200])), self._by_stretches(plain)
        return [next(stretched if a else alone) for a in apart]

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, dtype="<u4").tobytes() for x in self.library.encode(texts, num_threads=1)]

    def _by_stretches(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts whose blanks all stand alone between other characters: a stretch begins with the model's
        prefix, which stands for the blank before it."""
        start = size = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size < AT_ONCE and k < len(texts) - 1:
                continue
            lists = pc.split_pattern(pa.array(texts[start : k + 1], type=pa.string()), " ")
            coded = lists.flatten().dictionary_encode()
            keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            self.kept.turn()
            numbers = self.kept.known(keys)
            new = np.flatnonzero(numbers < 0)
            for lo in range(0, len(new), 20_000):
                some = [keys[n] for n in new[lo : lo + 20_000].tolist()]
                found = self.library.encode(some, num_threads=1)
                ends = np.cumsum(list(map(len, found)))
                numbers[new[lo : lo + 20_000]] = self.kept.add(some, np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(ends[-1])), ends)
            ids, ends = self.kept.ids_of(numbers[coded.indices.to_numpy()])
            raw, stops = ids.tobytes(), np.concatenate([[0], 4 * ends])[lists.offsets.to_numpy()].tolist()
            yield from (raw[x:y] for x, y in zip(stops, stops[1:]))
            start, size = k + 1, 0

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def chunks(self, text: str, size: int) -> list[tuple[str, int]]:
        """(characters, how many of them are the chunk's own) of each chunk; what follows those is looked at only."""
        if self.cuts:
            out, start = [], 0
            for m in re.finditer(r"(?<=\S) (?=\S)", text):
                if m.start() - start >= size:
                    out.append((text[start : m.start()], m.start() - start))
                    start = m.end()  # the prefix that is put before each chunk stands for this blank
            return [*out, (text[start:], len(text) - start)]
        if not self.unigram:
            return [(text, len(text))]
        text, size = self.library.normalize(text), max(size, self.longest)
        n = max(1, len(text) // size)  # the last chunk takes the rest
        return [(text[k * size : (k + 1) * size + self.longest - 1 if k < n - 1 else len(text)], size if k < n - 1 else len(text) - k * size) for k in range(n)]

    def edges(self, text: str, p: int) -> Iterator[tuple[int, int, float]]:
        """(length, id, score) of the pieces that begin at a place, shortest first."""
        for n in range(1, min(self.longest, len(text) - p) + 1):
            part = text[p : p + n]
            found = self.pieces.get(part)
            if found:
                yield n, *found
            elif n == 1:
                yield 1, self.unknown, self.unknown_score
            if part not in self.starts:
                return

    def transfer(self, text: str, own: int) -> np.ndarray:
        """The chunk's matrix. Once the scores of all entries differ by constants they stay so, and one is enough."""
        side = self.longest
        entries = side if own >= side else 1
        best = np.full((own + side, entries), -np.inf)
        best[np.arange(entries), np.arange(entries)] = 0.0
        p = 0
        while p < own:
            if p >= side and p % 32 == 0:
                with np.errstate(invalid="ignore"):
                    lead = best[p : p + side] - best[p : p + side, :1]
                some = best[p : p + side, 0] > -np.inf
                if np.isfinite(lead[some]).all() and (best[p : p + side][~some] == -np.inf).all() and (lead[some] == lead[some][0]).all():
                    row = self.paths(text, own, best[p : p + side, 0], p)[0][own : own + side]
                    return self._whole(np.array(row)[None, :] + lead[some][0][:, None])
            if best[p].max() > -np.inf:
                for n, _, score in self.edges(text, p):
                    np.maximum(best[p + n], best[p] + score, out=best[p + n])
            p += 1
        return self._whole(best[own : own + side].T)

    def _whole(self, t: np.ndarray) -> np.ndarray:
        return t if len(t) == self.longest else np.vstack([t, np.full((self.longest - len(t), self.longest), -np.inf)])

    def paths(self, text: str, own: int, scores: np.ndarray, begin: int = 0) -> tuple[list[float], bytearray, list[int]]:
        """For paths that enter with these scores: each place's best score, the length of its last piece and its entry."""
        best = [-math.inf] * (own + self.longest)
        lengths, entry = bytearray(len(best)), [0] * len(best)
        for i, x in enumerate(np.asarray(scores).tolist()):
            if begin + i < len(best):
                best[begin + i], entry[begin + i] = x, i
        for p in range(begin, own):
            now = best[p]
            if now > -math.inf:
                for n, _, score in self.edges(text, p):
                    if now + score > best[p + n]:
                        best[p + n], lengths[p + n], entry[p + n] = now + score, n, entry[p]
        return best, lengths, entry

    def trace(self, text: str, lengths: bytes, at: int) -> bytes:
        """The ids of the pieces that begin in a chunk, back from a place; each unknown character is one, or its bytes."""
        out: list[int] = []
        while lengths[at]:
            chars = text[at - lengths[at] : at]
            found = self.pieces.get(chars)
            if found:
                out.append(found[0])
            elif self.fallback and self.bytes:
                out += [self.bytes[b] for b in reversed(chars.encode())]
            else:
                out.append(self.unknown)
            at -= lengths[at]
        return np.array(out[::-1], dtype="<u4").tobytes()

    def joined(self, parts: list[bytes]) -> bytes:
        """The ids of all chunks; a run of unknown characters is one id, where they aren't bytes."""
        ids = np.frombuffer(b"".join(parts), dtype="<u4")
        if self.unigram and not (self.fallback and self.bytes):
            again = np.zeros(len(ids), dtype=bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            ids = ids[~again]
        return ids.tobytes()


def _table(values: list[tuple[Any, ...]], names: str, kinds: tuple[pa.DataType, ...]) -> pa.Table:
    columns = list(zip(*values)) or [[] for _ in kinds]
    return pa.table({n: pa.array(c, type=t) for n, c, t in zip(names.split(), columns, kinds)})


def _scanned(parts: DataFrame, store: Tables, path: str | None, made: bool) -> DataFrame:
    """key, k, doc_id and ids of the chunks of a unigram model's giants (key, doc_id, k, own, part)."""
    long, side = pa.int64(), load(path, made).longest
    floats = lambda x: np.frombuffer(x, dtype=float)
    group = F.floor(F.col("k") / GROUP).alias("g")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path, made)
        for batch in batches:
            for key, k, own, part in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _table([(key, k, m.transfer(part, own).tobytes())], "key k t", (long, long, pa.binary())).to_batches()

    def product(table: pa.Table) -> pa.Table:
        ms = [floats(t).reshape(side, side) for t in table.sort_by("k")["t"].to_pylist()]
        return _table([(table["key"][0].as_py(), table["g"][0].as_py(), reduce(max_plus, ms).tobytes())], "key g t", (long, long, pa.binary()))

    def over_groups(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        ms = [floats(t).reshape(side, side) for t in table["t"].to_pylist()]
        found = prefixes(ms, np.where(np.arange(side) == 0, 0.0, -np.inf))
        return _table([(key, g, f.tobytes()) for key, g, f in zip(table["key"].to_pylist(), table["g"].to_pylist(), found)], "key g f", (long, long, pa.binary()))

    def within(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        ms = [floats(t).reshape(side, side) for t in table["t"].to_pylist()]
        found = prefixes(ms, floats(table["f"][0].as_py()))
        return _table([(key, k, f.tobytes()) for key, k, f in zip(table["key"].to_pylist(), table["k"].to_pylist(), found)], "key k f", (long, long, pa.binary()))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path, made)
        for batch in batches:
            for key, k, own, part, f in zip(*(c.to_pylist() for c in batch.columns)):
                _, lengths, entry = m.paths(part, own, floats(f))
                choice = np.array(entry[own : own + side], dtype="<i4")
                yield from _table([(key, k, choice.tobytes(), bytes(lengths))], "key k choice lengths", (long, long, pa.binary(), pa.binary())).to_batches()

    ints = lambda x: np.frombuffer(x, dtype="<i4")

    def compose(table: pa.Table) -> pa.Table:
        found = composed([ints(c) for c in table.sort_by("k")["choice"].to_pylist()])
        return _table([(table["key"][0].as_py(), table["g"][0].as_py(), found.astype("<i4").tobytes())], "key g choice", (long, long, pa.binary()))

    def group_exits(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        found = exits([ints(c) for c in table["choice"].to_pylist()], 0)
        return _table(list(zip(table["key"].to_pylist(), table["g"].to_pylist(), found)), "key g last", (long, long, long))

    def chunk_exits(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        found = exits([ints(c) for c in table["choice"].to_pylist()], table["last"][0].as_py())
        return _table(list(zip(table["key"].to_pylist(), table["k"].to_pylist(), found)), "key k o", (long, long, long))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path, made)
        for batch in batches:
            for key, k, doc_id, own, part, lengths, o in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _table([(key, k, doc_id, m.trace(part, lengths, own + o))], "key k doc_id ids", (long, long, long, pa.binary())).to_batches()

    one = store(parts.select("key", "k", "own", "part").mapInArrow(matrices, "key long, k long, t binary").withColumn("g", group), "matrices")
    tops = one.groupBy("key", "g").applyInArrow(product, "key long, g long, t binary").groupBy("key").applyInArrow(over_groups, "key long, g long, f binary")
    entries = one.join(tops, ["key", "g"]).groupBy("key", "g").applyInArrow(within, "key long, k long, f binary")
    own = parts.join(entries, ["key", "k"]).select("key", "k", "own", "part", "f")
    choices = store(own.mapInArrow(chosen, "key long, k long, choice binary, lengths binary").withColumn("g", group), "choices")
    last = choices.select("key", "g", "k", "choice").groupBy("key", "g").applyInArrow(compose, "key long, g long, choice binary").groupBy("key").applyInArrow(group_exits, "key long, g long, last long")
    out = choices.select("key", "g", "k", "choice").join(last, ["key", "g"]).groupBy("key", "g").applyInArrow(chunk_exits, "key long, k long, o long")
    rows = parts.join(choices.select("key", "k", "lengths"), ["key", "k"]).join(out, ["key", "k"])
    return rows.select("key", "k", "doc_id", "own", "part", "lengths", "o").mapInArrow(traced, "key long, k long, doc_id long, ids binary")


def encode(docs: DataFrame, store: Tables, model: str | None = None, unigram: bool = False, giant: int = 65_536, chunk: int = 32_768) -> DataFrame:
    """doc_id, n_chunks and ids (little-endian u32) of each document; those over ``giant`` characters in chunks.

    unigram takes the unigram model of the file's pieces in place of the file's own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    small, large = rows.where(F.char_length("text") <= giant), rows.where(F.char_length("text") > giant)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = load(model, unigram).encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([1] * len(ids), type=pa.int64()), pa.array(ids, type=pa.binary())], names=["doc_id", "n_chunks", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = load(model, unigram).chunks(text, chunk)
                yield from _table([(key, doc_id, k, own, part) for k, (part, own) in enumerate(found)], "key doc_id k own part", (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())).to_batches()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, k, doc_id, part in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _table([(key, k, doc_id, load(model, unigram).encode([part])[0])], "key k doc_id ids", (pa.int64(), pa.int64(), pa.int64(), pa.binary())).to_batches()

    def gathered(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        return _table([(table["doc_id"][0].as_py(), len(table), load(model, unigram).joined(table["ids"].to_pylist()))], "doc_id n_chunks ids", (pa.int64(), pa.int64(), pa.binary()))

    # A giant's key is its own row's, so equal rows stay apart; chunks are dealt out evenly.
    numbered = large.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    parts = store(numbered.mapInArrow(split, "key long, doc_id long, k long, own long, part string"), "parts").repartition("key", "k")
    if load(model, unigram).unigram:
        done = _scanned(parts, store, model, unigram)
    else:
        done = parts.select("key", "k", "doc_id", "part").mapInArrow(each, "key long, k long, doc_id long, ids binary")
    giants = done.groupBy("key").applyInArrow(gathered, "doc_id long, n_chunks long, ids binary")
    return small.mapInArrow(whole, "doc_id long, n_chunks long, ids binary").unionByName(giants)


def decode(encoded: DataFrame, model: str | None = None, unigram: bool = False) -> DataFrame:
    """encoded (doc_id, ids, and more) with the text that the ids stand for."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [load(model, unigram).decode(x.as_py()) for x in batch.column(batch.schema.get_field_index("ids"))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(task, f"{kinds}, text string")
