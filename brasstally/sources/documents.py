"""Text documents, vector stores and evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasstally.errors import IngestError
from brasstally.sources.versions import read_version, write_version

KINDS = "*.{md,markdown,csv,json,txt}"
CASES = "question string, keywords array<string>, reference_answer string, category string"


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """text, source and doc_type (the top folder below the root); placeholders are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", KINDS).text(root, wholetext=True)
    named = raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
    top = F.element_at(F.split(F.element_at(F.split("source", rf"\Q{root.rstrip('/').split('/')[-1]}\E/"), -1), "/"), 1)
    return named.where(~F.lower("source").contains("placeholder")).withColumn("doc_type", top)


def write_store(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors (column embedding), as the store's new version; none at all is an error. A failed write leaves the version before it."""
    if chunks.isEmpty():
        raise IngestError("there are no chunks to store")
    write_version(chunks, path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return read_version(spark, path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).json(path, mode="FAILFAST")
