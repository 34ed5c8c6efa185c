"""Registered queries that write files to the shared folder and read them again; each run has a folder of its own there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasstally.oracles import COLUMNS_READ, READ_BY_FORMAT
from brasstally.plans import shared
from brasstally.plans.canonical import table
from brasstally.sources.datasets import DATASETS, Source, check_required, coerce, keep_first, load, read_files, union_by_name, with_headers, write_tables
from brasstally.sources.documents import read_cases, read_documents, read_store, write_store


def _folder(spark: SparkSession) -> str:
    return f"{shared.folder(spark)}/files-{uuid.uuid4().hex}"


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


def _raw(events: DataFrame, part: int) -> DataFrame:
    """Every third event and each tenth of all, so that some ids are in several files, with amounts that tell the file."""
    kept = events.where((F.pmod("event_id", F.lit(3)) == part) | (F.pmod("event_id", F.lit(10)) == 0))
    return kept.select(
        F.concat(F.lit("0"), F.col("event_id")).alias("Tx ID"), F.col("user_id").cast("string").alias("Acct-ID"), F.concat(F.lit("£1,00"), F.lit(part), F.lit(".25")).alias("AMT"),
        F.lit("GHS").alias("Ccy"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Created At"), F.col("event_type").alias("Narration"),
    )


def files_of_three_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV, JSON Lines and Parquet, written and read by format, under one contract; of a repeated id the first file's row stays."""
    events, spec, frames = table(spark, sf_dir, "events"), DATASETS["transactions"], []
    for part, fmt in enumerate(READ_BY_FORMAT):
        path = write_tables({f"{part}": _raw(events, part)}, _folder(spark), fmt)[f"{part}"]
        frames.append(coerce(with_headers(read_files(spark, path, fmt)), spec).withColumn("_part", F.lit(part)))
    whole = check_required(union_by_name(frames), spec)
    return _as_text(keep_first(whole, spec.key, ["_part", "_ord"])).select(*COLUMNS_READ)


def dataset_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset's folder with files of three formats in folders of their own, loaded as one; the first path's row stays."""
    events, root = table(spark, sf_dir, "events"), _folder(spark)
    for part, fmt in enumerate(READ_BY_FORMAT):
        write_tables({f"{part}": _raw(events, part)}, f"{root}/transactions", fmt)
    return _as_text(load(spark, "transactions", Source(root=root))).select(*COLUMNS_READ)


def json_of_three_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in JSON files of three shapes: a list of them, an object with rows under a key, and an object of its own each; regions decide which."""
    root, n = _folder(spark), table(spark, sf_dir, "nation")
    row = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 1, F.col("n_nationkey") / 2).alias("half")))
    listed = n.where("n_regionkey in (0, 1)").groupBy("n_regionkey").agg(F.concat_ws(",", F.collect_list(row)).alias("rows"))
    shapes = {
        "list": listed.where("n_regionkey = 0").select(F.concat(F.lit("[\n"), "rows", F.lit("\n]")).alias("value")),
        "keyed": listed.where("n_regionkey = 1").select(F.concat(F.lit('{"total": 1, "items": ['), "rows", F.lit("]}")).alias("value")),
        "single": n.where("n_regionkey > 1").repartition("n_nationkey").select(row.alias("value"), "n_nationkey"),
    }
    for name, df in shapes.items():
        df.write.partitionBy(*df.columns[1:]).text(f"{root}/{name}")
    paths = [f for name in shapes for f in spark.read.text(f"{root}/{name}").inputFiles()]
    read = read_files(spark, paths, "json", options={"pathGlobFilter": "*.txt"})
    shape = F.regexp_extract("_source_name", "/(list|keyed|single)/", 1)
    return read.where("id is not null").select(shape.alias("shape"), F.col("id").cast("long").alias("id"), "name", F.col("half").cast("double").alias("half"))


def documents_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each nation below a folder for its region; every fifth is a placeholder."""
    root = _folder(spark)
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("value"), F.col("n_regionkey").alias("region"), F.concat(F.when(F.col("n_nationkey") % 5 == 0, "placeholder").otherwise("n"), F.col("n_nationkey")).alias("name"))
    n.repartition("name").write.partitionBy("region", "name").text(root)
    return read_documents(spark, root).select("text", "doc_type")


def evaluation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as JSON Lines, read as cases."""
    path = _folder(spark)
    table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), F.split("text", " ").alias("keywords"), F.col("item_id").cast("string").alias("reference_answer"), F.lit("item").alias("category")).write.json(path)
    return read_cases(spark, path).select("question", F.array_join("keywords", ",").alias("keywords"), "reference_answer", "category")


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and vectors, stored twice: the second store replaces the first."""
    path, vectors = _folder(spark), table(spark, sf_dir, "embeddings")
    for rows in (vectors.where("vec_id < 0 or vec_id % 2 = 1"), vectors):
        write_store(rows, path)
    return read_store(spark, path).select("vec_id", F.size("embedding").alias("dimension"))


QUERIES = {f.__name__: f for f in (files_of_three_formats, dataset_of_files, json_of_three_shapes, documents_by_folder, evaluation_cases, vector_store)}
