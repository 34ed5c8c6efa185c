"""Versioned tables: each write is a folder of its own, and a pointer to it is written last.

A write that fails leaves no pointer, so readers keep the version before it; a reader that began with a version can go on, since no write touches its files.
A pointer also has the table's schema, so that no file is opened to infer it and names of partitions stay text.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brasstally.errors import IngestError

POINTER = "number long, version string, format string"


def _pointers(spark: SparkSession, root: str) -> list:
    """The pointers, newest first: a row for each version that was written."""
    try:
        rows = spark.read.schema(POINTER).json(f"{root.rstrip('/')}/pointers").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(rows, key=lambda r: (r["number"], r["version"]), reverse=True)


def exists(spark: SparkSession, root: str) -> bool:
    return bool(_pointers(spark, root))


def write_version(df: DataFrame, root: str, partition_by: tuple[str, ...] = (), keep: int | None = None) -> str:
    """A new version of the table at ``root``; with ``keep`` older ones than the newest so many are emptied."""
    spark, version, base = df.sparkSession, uuid.uuid4().hex, root.rstrip("/")
    df.write.partitionBy(*partition_by).parquet(f"{base}/versions/{version}")
    before = _pointers(spark, root)
    pointer = (F.lit(before[0]["number"] + 1 if before else 1).cast("long").alias("number"), F.lit(version).alias("version"), F.lit(df.schema.json()).alias("format"))
    spark.range(1).select(*pointer).coalesce(1).write.mode("append").json(f"{base}/pointers")
    for old in before[keep - 1 :] if keep else ():
        spark.createDataFrame([], "emptied boolean").write.mode("overwrite").parquet(f"{base}/versions/{old['version']}")
    return version


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The newest version, or the one that is named."""
    found = [p for p in _pointers(spark, root) if version in (None, p["version"])]
    if not found:
        raise IngestError(f"{root} holds no {'table' if version is None else f'version {version}'}")
    schema = T.StructType.fromJson(json.loads(found[0]["format"]))
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/versions/{found[0]['version']}").select(*schema.names)
