"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by range of page_id. The cuts between shards follow from exact sums of the pages' sizes (see
``ranges``), so the files depend on the pages alone, not on their partitioning, and a page_id with very many records
has several units. Each record is a gzip member of its own; a file ends once its compressed size reaches a limit,
and the next one starts with a fresh warcinfo record. Ids, lengths and digests of every header are computed anew. A
file gets its name when whole (before that it has a temporary one), and the manifest table, which Spark commits,
names the files of an archive. A task that runs again writes the same names and bytes.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is a
response, the others revisit it and carry no payload; smaller ones are all responses. A record's id is made of
page_id, payload digest and, where both are repeated, a number. Targets are percent-encoded where a URI has to be.

Cases: null html is an empty payload; a null url an empty target; a null page_id is larger than all others, and
a record of its own; equal page_ids are written each; an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesio.llm import ranges, shared

DATE = "2000-01-01T00:00:00Z"
#: Bytes that a record's headers are taken to have, and what stands in a URI as it is.
HEADERS, IN_URI = 512, "!#$%&'()*+,/:;=?@[]~"
FILES = pa.schema([("unit", pa.int64()), ("roll", pa.int64()), ("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])


def sizes(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, bytes and, of payloads of min_bytes or more, payload_digest of every page."""
    n = F.octet_length(F.coalesce("html", F.lit("")))
    return pages.select("page_id", n.alias("bytes"), F.when(n >= min_bytes, F.sha2("html", 256)).alias("payload_digest"))


def revisits(light: DataFrame, store: shared.Tables) -> DataFrame:
    """page_id, payload_digest and refers_to of the pages that are revisits."""
    digests = light.where("payload_digest is not null").select("page_id", "payload_digest")
    # Few digests have copies: only those, with the page that keeps the payload, meet the pages again.
    first = store(digests.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "first")
    return digests.join(first, "payload_digest").where("page_id is null or page_id > first").groupBy("page_id", "payload_digest").agg(F.min("first").alias("refers_to"))


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    pressed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pressed.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pressed.flush()


def name_of(page_id: int | None, digest: str, number: int = 0) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest[:32]}{f':{number}' if number else ''}>"


def page_record(page_id: int | None, number: int, url: str, html: str, refers_to: int | None) -> bytes:
    payload = html.encode()
    digest = hashlib.sha256(payload).hexdigest()
    fields = [("WARC-Record-ID", name_of(page_id, digest, number)), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url, safe=IN_URI)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields.append(("Content-Type", "application/http;msgtype=response"))
    if refers_to is None:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name_of(refers_to, digest))]
    return record("revisit", fields, http)


def write(pages: DataFrame, folder: str, roll_bytes: int = 64_000_000, min_bytes: int = 100, unit_bytes: int = 16 << 20) -> DataFrame:
    """Writes an archive of pages (page_id, url, html) under folder; returns its manifest, a row per file."""
    store = shared.Tables(pages.sparkSession, "warc-cuts")
    light = store(sizes(pages, min_bytes), "light")
    cuts = ranges.cut(light.select(F.col("page_id").alias("key"), (F.col("bytes") + HEADERS).alias("weight")), store, "pages", unit_bytes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, roll, out, files, mark, last, number = None, 0, None, [], (None, None, None), None, 0

        def close() -> None:
            out.commit()
            files.append({"unit": now, "roll": roll, "path": path, "n_records": n, "n_bytes": out.size, "sha256": whole.hexdigest()})

        try:
            for batch in batches:
                for page_id, url, html, digest, refers_to, unit in zip(*(c.to_pylist() for c in batch.columns)):
                    if html is None:  # a mark comes right before its pages
                        mark = (page_id, digest, refers_to)
                        continue
                    refers_to = mark[2] if mark[:2] == (page_id, digest) else None
                    number = number + 1 if last == (page_id, digest, unit) else 0
                    last = (page_id, digest, unit)
                    if unit != now:
                        if out is not None:
                            close()
                        now, roll, out = unit, 0, None
                    if out is None:
                        path = f"{folder}/pages-{unit:06d}-{roll:04d}.warc.gz"
                        out, n, whole = shared.Committed(path), 0, hashlib.sha256()
                        about = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{unit}-{roll}')}>"), ("WARC-Date", DATE), ("WARC-Filename", path.rpartition("/")[2]), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(about)
                        whole.update(about)
                    data = page_record(page_id, number, url, html, refers_to)
                    out.write(data)
                    whole.update(data)
                    n += 1
                    if out.size >= roll_bytes:
                        close()
                        out, roll = None, roll + 1
            if out is not None:
                close()
        except BaseException:
            if out is not None and not out.out.closed:
                out.abort()
            raise
        if files:
            yield pa.RecordBatch.from_pylist(files, schema=FILES)

    # Pages and marks go through one exchange, so html is moved once.
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("payload_digest"))
    both = rows.unionByName(revisits(light, store), allowMissingColumns=True)
    order = (F.col("page_id").asc_nulls_last(), F.col("payload_digest"), F.col("refers_to").asc_nulls_last(), F.col("url"))
    ordered = ranges.dealt(both, cuts, F.col("page_id"), F.xxhash64("payload_digest"), *order)
    rows = ordered.mapInArrow(task, "unit long, roll long, path string, n_records long, n_bytes long, sha256 string")
    manifest = shared.saved(rows, f"{folder}/manifest")
    store.drop("light", "first")
    return manifest


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file; raises where a length or digest is wrong."""
    at = 0
    while at < len(data):
        press, parts = zlib.decompressobj(31), []
        while not press.eof:
            if at >= len(data):
                raise ValueError("the last record is cut off")
            parts.append(press.decompress(data[at : at + 65536]))
            at += 65536
        at = min(at, len(data)) - len(press.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
        yield fields, block


def read(manifest: DataFrame) -> DataFrame:
    """The pages of an archive: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits).

    payload_bytes and payload_digest are of the full payload; for a response they are counted anew and the
    digest is held against its header, a revisit has them in its own headers.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, held = [], 0
                for fields, block in records(shared.read_bytes(path)):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    number = lambda name: None if (x := fields[name].split(":")[2]) == "null" else int(x)
                    revisit = fields["WARC-Type"] == "revisit"
                    size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                    out.append({"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To") if revisit else None, "html": None if revisit else payload.decode()})
                    held += len(payload)
                    if held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(task, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
