"""Files that executors write and read in the shared folder."""

from __future__ import annotations

import secrets
import uuid

from pyspark.sql import SparkSession

from cohesio.storage import Tables, delete, saved, shared_dir, work_dir

__all__ = ["Committed", "Tables", "delete", "file_system", "read_bytes", "saved", "secret_key", "shared_dir", "work_dir"]


def secret_key(spark: SparkSession) -> str:
    """The key in spark.cohesio.secret; where it is unset, one drawn for this run alone, whose surrogates no other run shares."""
    return spark.conf.get("spark.cohesio.secret", None) or secrets.token_hex(32)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; for use in executors."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Committed:
    """A file under a temporary name that gets its own name only when closed without an error."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex[:12]}.tmp"
        self.out, self.size = self.fs.open_output_stream(self.temporary, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temporary)


def read_bytes(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()
