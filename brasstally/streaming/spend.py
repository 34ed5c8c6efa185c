"""Running spend over a stream of transactions (an extension: the batch tools have no streaming twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasstally.functions import money


def spend_by_window(stream: DataFrame, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Total and count for each window, category and currency; rows later than ``lateness`` are left out."""
    amount = money.amount(F.col("amount"))
    return (
        stream.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", window).alias("w"), "category", "currency")
        .agg(money.total(amount).alias("total_amount"), F.count("*").alias("transaction_count"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "category", "currency", "total_amount", "transaction_count")
    )


def first_of_each(stream: DataFrame, key: str = "transaction_id", lateness: str = "1 day") -> DataFrame:
    """Rows without later repeats of a key within the watermark."""
    return stream.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark([key])
