"""Problem instances: feature vectors by node id and an affinity offset, from tables, arrays or text files."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the first line of the text format.
HEADER = "FACTORIZED COMPLETE MULTICUT"


@dataclass(frozen=True)
class Problem:
    """nodes: node_id long, features array<double>."""

    nodes: DataFrame
    offset: float = 0.0

    def __post_init__(self) -> None:
        if not math.isfinite(self.offset) or self.offset < 0:
            raise ValueError("the offset must be finite and not negative")

    @classmethod
    def from_table(cls, df: DataFrame, offset: float = 0.0, id_col: str = "vec_id", feature_col: str = "embedding", precision: str = "double") -> Problem:
        """From a table of vectors; 'single' rounds features to 32 bits first. Sums are always in double."""
        if precision not in ("single", "double"):
            raise ValueError(f"unknown precision {precision}")
        kind = "array<double>" if precision == "double" else "array<float>"
        return cls(df.select(F.col(id_col).cast("long").alias("node_id"), F.col(feature_col).cast(kind).cast("array<double>").alias("features")), float(offset))

    @classmethod
    def from_flat(cls, spark: SparkSession, values, num_nodes: int, dim: int, offset: float = 0.0) -> Problem:
        """From a flat row-major sequence of num_nodes * dim numbers."""
        import numpy as np
        import pyarrow as pa

        x = np.asarray(values, dtype=np.float64).reshape(-1)
        if len(x) != num_nodes * dim:
            raise ValueError(f"{num_nodes} x {dim} features need {num_nodes * dim} numbers, not {len(x)}")
        rows = pa.ListArray.from_arrays(pa.array(np.arange(num_nodes + 1, dtype=np.int32) * dim), pa.array(x))
        if not num_nodes:
            return cls(spark.createDataFrame([], "node_id long, features array<double>"), float(offset))
        return cls(spark.createDataFrame(pa.table({"node_id": pa.array(np.arange(num_nodes)), "features": rows})), float(offset))

    @classmethod
    def from_text(cls, spark: SparkSession, path: str, offset: float | None = None) -> Problem:
        """From a text file: the header line, the offset, then n and d, then n * d numbers.

        The given offset takes the place of the file's. A file is one task; tables are for large instances.
        """
        found = F.regexp_extract_all(F.expr("substr(value, instr(value, '\n') + 1)"), F.lit(r"(\S+)"), F.lit(1))
        file = spark.read.text(path, wholetext=True).select(F.trim(F.substring_index("value", "\n", 1)).alias("header"), found.alias("t"))
        row = file.select("header", F.slice("t", 1, 3).alias("head"), F.size("t").alias("n")).first()
        if row is None or row["header"].strip() != HEADER:
            raise ValueError(f"{path}: the first line isn't {HEADER!r}")
        if len(row["head"]) < 3:
            raise ValueError(f"{path}: the offset and both dimensions are needed")
        own, n, d = float(row["head"][0]), int(row["head"][1]), int(row["head"][2])
        if row["n"] - 3 != n * d:
            raise ValueError(f"{path}: {n} x {d} features need {n * d} numbers, not {row['n'] - 3}")
        ids = F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.explode(F.array().cast("array<int>"))
        nodes = file.select("t", ids.alias("i")).select(F.col("i").cast("long").alias("node_id"), F.expr(f"transform(slice(t, 4 + i * {d}, {d}), x -> cast(x as double))").alias("features"))
        return cls(nodes, own if offset is None else float(offset))

    def checked(self) -> Problem:
        """self, if ids are distinct and features complete and of equal length; else raises."""
        row = self.nodes.agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("ids"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"), F.max(F.exists("features", lambda x: x.isNull()).cast("int")).alias("nulls")).first()
        if row["n"] and (row["ids"] != row["n"] or row["low"] != row["high"] or row["low"] < 0 or row["nulls"]):
            raise ValueError("node ids must be distinct, and features without nulls and of equal length")
        return self

    def clusters(self) -> DataFrame:
        """Every node as a cluster of its own: cluster, size, fsum."""
        return self.nodes.select(F.col("node_id").alias("cluster"), F.lit(1).cast("long").alias("size"), F.col("features").alias("fsum"))


def write_labels(labels: DataFrame, path: str) -> None:
    """A cluster id per line in node order, as text. One task writes it, as the order asks; tables are the rule."""
    labels.orderBy("node_id").select(F.col("cluster").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)
