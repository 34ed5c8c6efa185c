"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A local session without that setting (tests) gets a temporary folder; a cluster without it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not ((sc.master or "") == "local" or (sc.master or "").startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="brasstally-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, so that no lost executor has it computed anew."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def key_crc32(col: Column) -> Column:
    """crc32 of an id's decimal text, the rule that assigns rows to folds."""
    return F.crc32(col.cast("string"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows (text, label) to fit a classifier on, none of them held out.

    Ids are taken in the order of a hash, so the same ids always give the same sample. A doc_id that is labelled twice counts
    once, with its larger label, and one that several documents share counts once, with the text that sorts first. Null labels and ids are ignored.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(key_crc32(F.col("doc_id")) % folds != held_out)
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("label"))
    )
    # the ids are at most max_rows, a parameter, so sending them to every task is bounded
    chosen = (
        docs.select("doc_id").distinct().join(chosen, "doc_id")
        .orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(max_rows)
    )
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = text.join(F.broadcast(cut(chosen)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return cut(found.select("text", "label"))


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with further columns, each given with its SQL type."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in columns.items())).fields])
