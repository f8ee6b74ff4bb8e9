"""Self-join of documents by the Jaccard similarity of their word shingles, along chosen paths.

Documents with equal shingle sets are one node. A node's set has a signature of 64 min-hashes, each a token
sampled from the set alike for all sets. From a run's root, a set goes down to the children named by
(coordinate, min-hash) for a few coordinates, chosen by hashing the path, 1 / threshold of them on average:
two sets meet again in a child when they share the sampled token. After two levels buckets are small and are
brute-forced; larger ones are split further, and those still large at the last level are dealt out as pairs
of blocks, so no bucket is cut off and no task holds an unbounded one. Runs are repeated until a pair at the
threshold meets with the target probability: with s(d+1) = 1 - exp(-s(d)) for d levels, (1 - s)^runs is at
most 1 - recall.

Pairs whose signatures agree well make candidate edges, a spanning forest of each bucket, and components of
those are verified by exact intersections of their shingle sets, all pairs of a component, again in blocks.
So a pair is only lost if nothing joins its two sets; links are exact, never estimated. What leaves a task is
a forest and a number of links for each node, in proportion to the rows that came in.

Words are runs without ASCII white space, case kept; a text of fewer words than a shingle has is one shingle.
Hot keys: what is joined by path, root or node are stored tables on both sides, so a hot one's rows are split at
run time; texts without shingles pass by the joins; blocks of verified sets are bounded by bytes too.

Cases: null and empty texts have no shingle, each is a class of its own without links; rows with a null doc_id
take part and come last where ids are compared, so a class has a null class_id only if all its ids are null;
rows with one doc_id and different texts come back each, as do repeated rows; an empty table gives an empty
result; other columns are not read. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesio.llm import components
from cohesio.storage import Tables

COORDINATES = 64
BLOCK_BYTES = 64 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    import xxhash

    words = (text or "").encode().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - size + 1)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(h))):
        s = s * _M + h[k : k + n]
    return np.unique(mixed(s))


def signature(s: np.ndarray) -> np.ndarray:
    """Min-hashes of a set of hashes."""
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint64)
    for lo in range(0, len(s), 8192):
        np.minimum(out, ((s[lo : lo + 8192, None] * FACTORS) >> np.uint64(32)).min(axis=0), out=out)
    return out.astype("<u4")


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a bucket of that depth with probability recall."""
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-s)
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def children(paths: np.ndarray, sigs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of every child of each row's path."""
    dice = mixed(paths[:, None] + FACTORS[None, :])
    row, i = np.nonzero(dice < np.uint64(2**64 / (threshold * COORDINATES)))
    return row, mixed(mixed(paths[row] + FACTORS[i]) ^ (sigs[row, i].astype(np.uint64) * _M))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, hash and text: id and hash of the text tell rows apart, but for rows alike in both."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, hash, node (a hash of the shingle set, null where empty), its number of shingles and sig of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("node", pa.int64()), ("shingles", pa.int64()), ("sig", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, counts, sigs = [], [], []
            for x in batch.column(2):
                s = shingles(x.as_py(), size)
                nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                counts.append(len(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, type=pa.int64()), pa.array(counts, type=pa.int64()), pa.array(sigs, type=pa.binary())], schema=schema)

    return keyed(docs).mapInArrow(task, "doc_id long, hash long, node long, shingles long, sig binary")


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, COORDINATES)


def descend(rows: DataFrame, threshold: float, levels: int, runs: int = 0) -> DataFrame:
    """(node, path) after so many levels, from (node, sig) for all runs or from (node, sig, path) where runs is 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                nodes, sigs = batch.column(0).to_numpy(), _sigs(batch.column(1))
                starts = mixed(np.arange(1, runs + 1, dtype=np.uint64)) if runs else [None]
                for start in starts:
                    row = np.arange(len(nodes))
                    path = np.full(len(nodes), start, dtype=np.uint64) if runs else batch.column(2).to_numpy().view(np.uint64)
                    for _ in range(levels):
                        kept, path = children(path, sigs[row], threshold)
                        row = row[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[row]), pa.array(path.view(np.int64))], names=["node", "path"])

    return rows.select("node", "sig", *(() if runs else ("path",))).mapInArrow(task, "node long, path long")


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted stream into runs of whole groups by its first columns; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [batch.column(c).to_numpy() for c in range(keys)]
        same = np.ones(batch.num_rows, dtype=bool)
        for c in k:
            same &= c == c[-1]
        last = batch.num_rows - int(same[::-1].argmin()) if not same.all() else 0
        joined = held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in range(keys))
        if held and not (joined and last == 0):
            if joined:  # the held group ends within this batch
                held.append(batch.slice(0, last))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = [batch.slice(last)]
                continue
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if last:
            yield batch.slice(0, last)
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def group_slices(batch: pa.RecordBatch, keys: int) -> list[tuple[int, int]]:
    new = np.ones(batch.num_rows, dtype=bool)
    new[1:] = False
    for c in range(keys):
        k = batch.column(c).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip(at, at[1:] + [batch.num_rows]))


def roots(adjacent: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    label = np.arange(len(adjacent))
    near = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        new = np.where(near, label[None, :], len(label)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_pairs(rows: DataFrame, size: str, block: int, bytes_: str | None = None) -> DataFrame:
    """rows with bi, bj and side: a group of up to block rows is one unit, a larger one all pairs of its blocks.

    A group of n rows has n / block blocks but at most 16, as long as blocks stay under 4096 rows and, where a
    column tells the group's bytes, under BLOCK_BYTES.
    """
    n = F.col(size)
    g = F.greatest(F.least(F.ceil(n / block), F.lit(16)), F.ceil(n / 4096), *([F.ceil(F.col(bytes_) / BLOCK_BYTES)] if bytes_ else [])).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), g).cast("int")
    rows = rows.withColumn("_g", g).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return rows.withColumn("bi", F.least("_own", "_other")).withColumn("bj", F.greatest("_own", "_other")).withColumn("side", F.col("_own")).drop("_g", "_own", "_other")


def likely(rows: DataFrame, least: float) -> DataFrame:
    """Candidate edges (u, v) from bucket rows (path, bi, bj, node, sig), a forest of each bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_groups(batches, 3):
            nodes, sigs = batch.column(3).to_numpy(), _sigs(batch.column(4))
            groups, u, v = group_slices(batch, 3), [], []
            two = np.array([a for a, b in groups if b - a == 2], dtype=np.int64)
            if len(two):
                two = two[(sigs[two] == sigs[two + 1]).mean(axis=1) >= least]
                u.append(nodes[two]), v.append(nodes[two + 1])
            for a, b in groups:
                if b - a > 2:
                    s, agree = sigs[a:b], np.zeros((b - a, b - a), dtype=np.uint8)
                    for k in range(COORDINATES):
                        agree += s[:, k, None] == s[None, :, k]
                    root = roots(agree >= least * COORDINATES)
                    u.append(nodes[a:b]), v.append(nodes[a:b][root])
            if u:
                u, v = np.concatenate(u), np.concatenate(v)
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    ordered = rows.select("path", "bi", "bj", "node", "sig").repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj")
    return ordered.mapInArrow(task, "u long, v long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[place] > 1
    place, owner = place[shared], owner[shared]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    _, place = np.unique(place, return_inverse=True)
    width = max(1, 16_000_000 // len(sets))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [lo, lo + width])
        m = np.zeros((len(sets), width if lo + width <= place[-1] else int(place[-1]) + 1 - lo), dtype=np.float32)
        m[owner[a:b], place[a:b] - lo] = 1
        out += m @ m.T
    return out


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) from rows (root, bi, bj, side, node, set): a forest of true links, and their numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_groups(batches, 3):
            nodes, side, sets = batch.column(4).to_numpy(), batch.column(3).to_numpy(), [np.frombuffer(x, dtype="<u8") for x in batch.column(5).to_pylist()]
            two_sided = batch.column(1).to_numpy() != batch.column(2).to_numpy()
            found = []
            for a, b in group_slices(batch, 3):
                size = np.array([len(s) for s in sets[a:b]])
                common = overlaps(sets[a:b])
                linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
                np.fill_diagonal(linked, False)
                if two_sided[a]:
                    linked &= side[a:b, None] != side[None, a:b]
                found.append((nodes[a:b], nodes[a:b][roots(linked)], linked.sum(axis=1)))
            node, root, links = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(links.astype(np.int64))], names=["node", "root", "links"])

    ordered = rows.select("root", "bi", "bj", "side", "node", "set").repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    return ordered.mapInArrow(task, "node long, root long, links long")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, root, n, bytes, set) of the wanted nodes (doc_id, hash, node, root, n, bytes), shingled anew from their texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out, keep = [], []
            for k, (node, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4))):
                s = shingles(text.as_py(), size)
                if xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 == node:
                    keep.append(k), out.append(s.astype("<u8").tobytes())
            few = batch.take(pa.array(keep, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*few.columns[:4], pa.array(out, type=pa.binary())], names=["node", "root", "n", "bytes", "set"])

    texts, own = keyed(docs), wanted.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    rows = texts.join(own, texts["doc_id"].eqNullSafe(own["_id"]) & (texts["hash"] == own["_hash"])).select("node", "root", "n", "bytes", "text")
    return rows.mapInArrow(task, "node long, root long, n long, bytes long, set binary").dropDuplicates(["node"])


def join(docs: DataFrame, store: Tables, size: int = 5, threshold: float = 0.8, recall: float = 0.999, small: int = 1000, depth: int = 4, bucket_block: int = 512, block: int = 128) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, hash (of the text), class_hash and is_first of each document (doc_id, text).

    class_id is the least doc_id of all documents joined by links, through others too; n_links counts the other
    nodes (different shingle sets) at the threshold or above; n_copies the documents with the same set; is_first
    marks the rows with the least (doc_id, hash) of a class, which are one row and its repeats; (class_id,
    class_hash) names the class.
    """
    sketches = store(sketch(docs, size), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash"))
    nodes = store(sketches.where("node is not null").groupBy("node").agg(first.alias("first"), F.count("*").alias("copies"), F.max("shingles").alias("shingles"), F.min("sig").alias("sig")), "nodes")
    candidates, rows = None, descend(nodes, threshold, 2, runs_needed(threshold, recall, depth))
    for level in range(2, depth + 1):
        rows = store(rows, f"paths-{level}")
        counts = store(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), f"counts-{level}")
        shared = rows.join(counts, "path").join(nodes.select("node", "sig"), "node")
        if level < depth:
            shared = store(shared, f"buckets-{level}")
        ready = block_pairs(shared if level == depth else shared.where(F.col("n") <= small), "n", bucket_block)
        edges = likely(ready, threshold - 0.2)
        candidates = edges if candidates is None else candidates.unionByName(edges)
        if level == depth or shared.where(F.col("n") > small).isEmpty():
            break
        rows = descend(shared.where(F.col("n") > small), threshold, 1)
    roots_ = store(components.connected(candidates, store, "likely").join(nodes.select("node", "first", "shingles"), "node"), "roots")
    store.drop("paths-", "counts-", "buckets-", "likely-")
    sizes = store(roots_.groupBy("root").agg(F.count("*").alias("n"), (F.sum("shingles") * 8).alias("bytes")), "sizes")
    wanted = roots_.join(sizes, "root").select("first.doc_id", "first.hash", "node", "root", "n", "bytes")
    sets = store(sets_of(docs, wanted, size), "sets")
    links = store(verified(block_pairs(sets, "n", block, "bytes"), threshold), "links")
    true_roots = store(components.connected(links.select(F.col("node").alias("u"), F.col("root").alias("v")), store, "true"), "classes")
    store.drop("sets", "true-")
    numbers = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    labelled = store(nodes.select("node", "first", "copies").join(true_roots, "node", "left").join(numbers, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    firsts = store(labelled.groupBy("root").agg(F.min("first").alias("class")), "firsts")
    known = labelled.join(firsts, "root").select("node", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    is_first = F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("hash") == F.col("class.hash"))
    found = sketches.where("node is not null").join(known, "node").select("doc_id", F.col("class.doc_id").alias("class_id"), "n_links", "n_copies", "hash", F.col("class.hash").alias("class_hash"), is_first.alias("is_first"))
    none = sketches.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "hash", F.col("hash").alias("class_hash"), F.lit(True).alias("is_first"))
    return found.unionByName(none)
