"""Tables in the folder that the driver and all executors share; they cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, where it may be unset, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="cohesio-"))


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new name under the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends here, and a lost executor costs nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Keeps frames as tables of one new folder, and drops those that nothing reads any more."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.names = spark, work_dir(spark, tag), set()

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        return saved(df, f"{self.folder}/{name}")

    def drop(self, *starts: str) -> None:
        """Deletes the tables whose names begin so."""
        for name in [n for n in self.names if n.startswith(starts)]:
            delete(self.spark, f"{self.folder}/{name}")
            self.names.discard(name)


def keeper(spark: SparkSession, tag: str) -> Tables:
    return Tables(spark, tag)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
