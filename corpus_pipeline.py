"""From documents to packed bins: quality rules, near-duplicate removal, surrogates for personal data, packing.

Each stage works on all rows that the one before kept, written as Parquet and read again. Stages decide by
(doc_id, text), so rows alike in both fare alike, but that of repeated rows with words one stays. Null ids are
compared as the largest. Columns besides those of documents pass through all but the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohesio.llm import ngram_join, packing, pii, quality, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    store = shared.Tables(spark, "pipeline-quality")
    keyed = docs.select("source", "text", F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    judged = quality.judged(store(quality.measure(keyed, ["id", "hash"]), "measures"))
    rejected = store(judged.where(~F.col("kept")).select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct(), "rejected")
    # By merge at every size: the rejected grow with the documents.
    rejected = rejected.hint("merge")
    return docs.join(rejected, rejected["_id"].eqNullSafe(docs["doc_id"]) & (rejected["_hash"] == F.xxhash64(docs["text"])), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the least (doc_id, hash of the text); of its repeats one."""
    store = shared.Tables(spark, "pipeline-near")
    joined = store(ngram_join.join(docs, store), "joined")
    key = [F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")]
    # Texts without words are no duplicates, so none of their rows is repeated: their n_copies is 1.
    repeats = joined.where("is_first and n_copies > 1").groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1")
    repeated = store(repeats.select(*key), "repeated")
    rejected = store(joined.where("not is_first").select(*key).distinct().unionByName(repeated), "rejected")
    same = lambda few: few["_id"].eqNullSafe(docs["doc_id"]) & (few["_hash"] == F.xxhash64(docs["text"]))
    kept = docs.join(rejected.hint("merge"), same(rejected), "left_anti")
    if repeated.isEmpty():
        return kept
    # Their other columns may differ: the first row in JSON's order stays.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = docs.join(repeated.hint("merge"), same(repeated), "left_semi").groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return kept.unionByName(one.select(*(F.col(f"_row.`{c}`") for c in docs.columns)))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates, by the key in spark.cohesio.secret or one of this run's; n_chars follows the text."""
    done = pii.replaced(docs, shared.Tables(spark, "pipeline-pii"), shared.secret_key(spark))
    columns = [F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document or piece of one: its bin and place there."""
    return packing.packed(docs, F.octet_length("text") + 1, F.xxhash64("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", surrogates),
    ("best-fit packing", best_fit),
]

#: Near-duplicate groups, surrogates and best fit are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on documents."""
    docs, store = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.Tables(spark, "pipeline")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
