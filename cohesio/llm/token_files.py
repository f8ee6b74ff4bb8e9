"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a run of blocks. Each block holds whole documents in ascending doc_id order:

    magic "CTB1" ("CTBN" where the documents have null ids, which are written as 0), then little-endian counts: documents (u32), ids (u64), distinct ids (u32), data bytes (u64)
    doc_id (i64) and number of ids (u64) of each document
    distinct ids (u32) by falling frequency in the block, ties by id: an id's place is its rank
    control bytes: two bits for each id (lowest bits first), its rank's length less one
    data bytes: each rank in that many bytes, little-endian

Ranks are a block's own, so writing takes one pass and memory is bounded by a block. Frequent ids take one
byte. Decoding looks lengths up by control byte, so numpy decodes a block without a loop over ids.

Which documents a file holds follows from exact sums of the texts' sizes (see ``ranges``), so files depend on the
table alone, not on its partitioning.

Cases: a null or empty text has the end id alone; equal doc_ids stay apart, in the order of their texts (those of
a doc_id heavier than a file in several files by hash); null doc_ids come last; an empty table gives no file and
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesio.llm import byte_bpe, ranges, shared

MAGIC, NULLS = b"CTB1", b"CTBN"
HEAD = struct.Struct("<4sIQIQ")
#: Lengths (1 to 4) that each control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
LANES = np.arange(4, dtype=np.uint8)


def pack_block(doc_ids: list[int | None], texts_ids: list[bytes]) -> bytes:
    """One block of documents, given each one's ids as little-endian u32; their doc_ids are all null, or none is."""
    counts = np.array([len(x) // 4 for x in texts_ids], dtype="<u8")
    ids = np.frombuffer(b"".join(texts_ids), dtype="<u4")
    seen, place, often = np.unique(ids, return_inverse=True, return_counts=True) if len(ids) and int(ids.max()) > 1 << 24 else _dense(ids)
    order = np.lexsort((seen, -often))
    rank_of = np.empty(len(seen), dtype="<u4")
    rank_of[order] = np.arange(len(seen), dtype="<u4")
    ranks = rank_of[place]
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    padded[: len(ids)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[LANES < size[:, None]]
    null = bool(doc_ids) and doc_ids[0] is None
    head = HEAD.pack(NULLS if null else MAGIC, len(doc_ids), len(ids), len(seen), len(data))
    return b"".join([head, np.array([0] * len(doc_ids) if null else doc_ids, dtype="<i8").tobytes(), counts.tobytes(), seen[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    often = np.bincount(ids)
    seen = np.flatnonzero(often)
    place = np.zeros(len(often), dtype=np.int64)
    place[seen] = np.arange(len(seen))
    return seen, place[ids], often[seen]


def unpack_blocks(data: bytes) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
    """(doc_ids or None where they are null, numbers of ids, all ids) of each block of a file."""
    at = 0
    while at < len(data):
        magic, docs, n, distinct, size = HEAD.unpack_from(data, at)
        if magic not in (MAGIC, NULLS):
            raise ValueError("not a token file")
        at += HEAD.size
        parts = []
        for dtype, count in (("<i8", docs), ("<u8", docs), ("<u4", distinct), ("u1", -(-n // 4)), ("u1", size)):
            parts.append(np.frombuffer(data, dtype=dtype, count=count, offset=at))
            at += parts[-1].nbytes
        doc_ids, counts, table, control, packed = parts
        sizes = LENGTHS[control].reshape(-1)[:n]
        lanes = np.zeros((n, 4), dtype=np.uint8)
        lanes[LANES < sizes[:, None]] = packed
        yield None if magic == NULLS else doc_ids, counts, table[lanes.view("<u4").reshape(-1)]


def write(docs: DataFrame, folder: str, end_id: int = 2, tokenizer: str | None = None, block_ids: int = 2_000_000, file_bytes: int = 16 << 20) -> DataFrame:
    """Writes the texts' ids to files under folder in ascending doc_id order; returns the manifest.

    File k holds smaller doc_ids than file k + 1. A file gets its name when whole; a task that runs again writes the
    same bytes under the same name. The manifest, one row per file (file, path, n_docs, n_ids, start), is a table
    beside the files; start counts the ids of earlier files.
    """
    store = shared.Tables(docs.sparkSession, "token-cuts")
    weights = docs.select(F.col("doc_id").alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("weight"))
    cuts = ranges.cut(weights, store, "docs", file_bytes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_bpe.load(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        now, out, held, names, size, n_docs, n_ids, files, path = None, None, [], [], 0, 0, 0, [], ""

        def flush() -> None:
            nonlocal out, held, names, size, n_docs, n_ids
            if names:
                out = out or shared.Committed(path)
                out.write(pack_block(names, held))
                n_docs, n_ids, held, names, size = n_docs + len(names), n_ids + size, [], [], 0

        def close() -> None:
            nonlocal out, n_docs, n_ids
            flush()
            if out:
                out.commit()
                files.append({"file": now, "path": path, "n_docs": n_docs, "n_ids": n_ids})
            out, n_docs, n_ids = None, 0, 0

        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 4000):
                    ids, texts, units = (c.to_pylist() for c in batch.slice(lo, 4000).columns)
                    for key, x, unit in zip(ids, encoder.encode([t or "" for t in texts]), units):
                        if unit != now:
                            close()
                            now, path = unit, f"{folder}/ids-{unit:06d}.bin"
                        elif names and (names[-1] is None) != (key is None):
                            flush()
                        names.append(key)
                        held.append(x + end)
                        size += len(held[-1]) // 4
                        if size >= block_ids:
                            flush()
            close()
        except BaseException:
            if out and not out.out.closed:
                out.abort()
            raise
        if files:
            yield pa.RecordBatch.from_pylist(files, schema=pa.schema([("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = ranges.dealt(docs.select("doc_id", "text"), cuts, F.col("doc_id"), F.xxhash64("text"), F.col("doc_id").asc_nulls_last(), F.col("text"))
    files = shared.saved(ordered.mapInArrow(task, "file long, path string, n_docs long, n_ids long"), f"{folder}/files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return shared.saved(files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))), f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest: doc_id, start, n_tokens and ids_crc32 of each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                for doc_ids, counts, ids in unpack_blocks(shared.read_bytes(row["path"])):
                    ends = np.cumsum(counts.astype(np.int64))
                    starts = ends - counts.astype(np.int64)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(counts), pa.int64()) if doc_ids is None else pa.array(doc_ids), pa.array(starts + start), pa.array(ends - starts), pa.array(crcs, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    files = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")
