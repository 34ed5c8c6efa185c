"""Views over the driver's tables that stand for raw and processed transactions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasstally.operators import categories, normalize, recurrence
from brasstally.plans import shared
from brasstally.sources.datasets import keep_first
from brasstally.sources.versions import exists, read_version, write_version

# Columns that the events lack, chosen by their ids.
CURRENCIES = ("GHS", "GBP", "USD")
MERCHANTS = ("Melcom GH", "Shell retail", "uber bv", "salary", "Bolt EU")
CATEGORIES = ("transfer", "utility", "supermarket", "restaurant", "bank_fee", "atm_withdrawal", "utilities")
OUTGOING = ("purchase", "view")


def _pick(values: tuple[str, ...], column: str):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("account_id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type").isin(*OUTGOING), -F.col("value")).otherwise(F.col("value")).alias("amount"),
        _pick(CURRENCIES, "user_id").alias("currency"), _pick(MERCHANTS, "event_id").alias("merchant"), _pick(CATEGORIES, "event_id").alias("category"),
        F.col("props").alias("description"), F.col("event_id").alias("_ord"),
    )


def for_mapping(normalized: DataFrame) -> DataFrame:
    """The normalized columns under the names that the mapping expects."""
    return normalized.withColumns({"merchant_normalized": F.lower("merchant_clean"), "category_normalized": F.col("category")})


def unnormalized_for_mapping(raw: DataFrame) -> DataFrame:
    """Raw names with a direction: so all rules can be met, which the normalized categories don't allow."""
    return normalize.transactions(raw.withColumn("_raw_category", F.col("category"))).withColumns({"merchant_normalized": F.lower("merchant")}).withColumn("category_normalized", F.col("_raw_category")).drop("_raw_category")


def mapped(raw: DataFrame) -> DataFrame:
    """Raw transactions normalized, without repeated ids and mapped: all that lookups and spend summaries need."""
    first = keep_first(raw, "transaction_id", ["_ord"])
    return categories.map_categories(for_mapping(normalize.transactions(first)))


def processed(raw: DataFrame) -> DataFrame:
    """Mapped transactions with their labels of recurrence."""
    return recurrence.label(mapped(raw))


def served(df: DataFrame) -> DataFrame:
    """Processed transactions under the names that the query tools expect."""
    return df.drop("merchant", "category").withColumnsRenamed({"merchant_mapped": "merchant", "category_mapped": "category", "subcategory_mapped": "subcategory"})


def weekly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped transactions with a cadence: one of a constant amount for each user, kind and week."""
    weeks = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("week", F.col("ts").cast("timestamp")).alias("timestamp")).distinct()
    key = F.concat_ws("-", "user_id", "event_type", F.date_format("timestamp", "yyyyMMdd"))
    return weeks.select(
        key.alias("transaction_id"), F.col("user_id").cast("string").alias("account_id"), "timestamp", F.lit(10.0).alias("amount"), F.lit("GHS").alias("currency"), F.lit("debit").alias("direction"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("merchant_mapped"), F.col("event_type").alias("category_mapped"), F.lit("general").alias("subcategory_mapped"), key.alias("_ord"),
    )


def write_processed(df: DataFrame, root: str) -> None:
    """A new version of the processed transactions, by month, so that a range of dates reads only its months.

    Large months are dealt over several files by measured size, and rows are sorted by account within a file, so that the statistics of row groups let lookups of accounts skip most of them."""
    month = F.date_format("timestamp", "yyyy-MM")
    dealt = df.drop("month").withColumn("month", month).hint("rebalance", "month")
    write_version(dealt.sortWithinPartitions("month", "account_id", "timestamp"), root, ("month",))


def read_processed(spark: SparkSession, root: str) -> DataFrame:
    return read_version(spark, root)


def processed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed transactions of the tables in ``sf_dir`` as a stored table in the shared folder.

    The first call for the files as they are now processes and writes them, later ones only read. Files are told apart by path, size and time of change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/events.parquet")
    state = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("files")).first()
    root = f"{shared.folder(spark)}/processed-{hashlib.md5(repr((sf_dir, *state)).encode()).hexdigest()}"
    if not exists(spark, root):
        write_processed(processed(raw_transactions(spark, sf_dir)), root)
    return read_processed(spark, root)
