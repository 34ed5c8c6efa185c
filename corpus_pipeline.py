"""From raw documents to packed training sequences, each stage on all that the one before it kept.

What the stages do with unusual rows: null texts count as empty ones and pass both filters if the learned scores let them; rows without a doc_id or
with one that others have, too, are documents of their own, told apart by a hash of their text, and only rows that agree in doc_id and text are
copies; null sources share one weight of the mix; further columns stay up to the last stage, also those named like a column that an operator
adds; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brasstally.llm import mixing, near_copies, packing, quality, toxicity
from brasstally.llm.common import shared_folder, table


#: The columns of documents, which operators may read.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _as_own(docs: DataFrame) -> DataFrame:
    """``docs`` with every column but doc_id, text and the other columns of documents under a name of its own, so that none clashes."""
    return docs.toDF(*(c if c in DOCUMENT else f"own_{c}" for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    own = _as_own(docs)
    found = toxicity.score(own, toxicity.train(own, table(spark, sf_dir, "labels")))
    return found.where("predicted = 0").select(*own.columns).toDF(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for them."""
    own = _as_own(docs)
    found = quality.score(own, quality.train(own, table(spark, sf_dir, "labels")))
    return found.where("predicted = 1").select(*own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 alike): the one with the smallest doc_id, then hash of its text.

    Documents without a doc_id take part and come last in that order. Of rows that agree in doc_id and text the one whose other columns sort first stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")).alias("first")
    # one text for an id or for none, so that the join and the window share a partitioning
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    kept = near_copies.grouped(docs).groupBy("component").agg(first).select(name("first.doc_id").alias("_name"), F.col("first.tie").alias("_tie"))
    named = docs.withColumns({"_name": name("doc_id"), "_tie": F.xxhash64("text")})
    found = named.join(kept, ["_name", "_tie"], "left_semi")
    others = [c for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t]
    order = Window.partitionBy("_name", "_tie").orderBy(*(others or ["doc_id"]))
    return found.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    own = _as_own(docs)
    return mixing.mixed(own).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences, which follow the order of the mix."""
    return packing.pack_in_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The learned stages and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete what a later stage has replaced, through the file system that the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others are written as Parquet to the shared folder and read again.

    A stage's files are removed once the next one's are written; those that the result still reads stay. Checkpoints in the shared folder go with
    their DataFrames where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
