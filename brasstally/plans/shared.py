"""Rows that several steps read are computed once and kept in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a temporary folder; a cluster without it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found is None:
        if (sc.master or "").partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="brasstally-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()
