"""Labels of recurring payments by cadence and steadiness of amounts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasstally.errors import RecurrenceConfigError, RecurrenceInputError
from brasstally.functions import fixed, money, text

NEEDED = ("transaction_id", "timestamp", "amount", "direction", "merchant_mapped", "category_mapped", "subcategory_mapped")
DAY_MICROS = 86_400_000_000


@dataclass(frozen=True)
class RecurrenceConfig:
    """Thresholds. With ``absolute_reference`` the relative tolerance also holds for negative amounts, and with
    ``by_account`` streams of different accounts stay apart; both are off by default."""

    min_group: int = 3
    ratio: float = 0.05
    difference: float = 5.0
    weekly_window: int = 2
    biweekly_window: int = 3
    monthly_window: int = 5
    high_from: int = 4
    medium_from: int = 3
    irregular_span: int = 10
    absolute_reference: bool = False
    by_account: bool = False

    def checked(self) -> RecurrenceConfig:
        sizes_fit = 2 <= self.min_group <= self.medium_from <= self.high_from
        if not sizes_fit or min(self.ratio, self.difference, self.weekly_window, self.biweekly_window, self.monthly_window, self.irregular_span) < 0:
            raise RecurrenceConfigError(f"group sizes must rise from 2 and tolerances must not be negative: {self}")
        return self

    def cadences(self) -> tuple[tuple[str, int, int], ...]:
        return (("weekly", 7, self.weekly_window), ("biweekly", 14, self.biweekly_window), ("monthly", 30, self.monthly_window))


def _gap(later: Column, earlier: Column) -> Column:
    """Whole days of elapsed time between two timestamps in order."""
    return F.call_function("div", F.unix_micros(later) - F.unix_micros(earlier), F.lit(DAY_MICROS))


def _cadence(config: RecurrenceConfig, gaps: Column, low: Column, high: Column) -> Column:
    chain = F.when(gaps == 0, "none")
    for name, days, window in config.cadences():
        chain = chain.when((low >= days - window) & (high <= days + window), name)
    return chain.when(high - low <= config.irregular_span, "irregular").otherwise("none")


def _confidence(config: RecurrenceConfig, n: Column, gaps: Column, low: Column, high: Column, steady: Column) -> Column:
    tight = min(config.weekly_window, config.biweekly_window, config.monthly_window)
    regular = F.col("recurrence_cadence").isin("weekly", "biweekly", "monthly")
    return (
        F.when((F.col("recurrence_cadence") == "none") | (n < config.min_group) | ~steady | (gaps == 0), "low")
        .when((n >= config.high_from) & regular & (high - low <= tight), "high")
        .when(n >= config.medium_from, "medium")
        .otherwise("low")
    )


def invalid_counts(df: DataFrame) -> dict[str, int]:
    """How many timestamps and amounts have no value."""
    bad = [F.count_if(F.col("timestamp").try_cast("timestamp").isNull()).alias("timestamp"), F.count_if(money.not_nan(F.col("amount").try_cast("double")).isNull()).alias("amount")]
    return df.agg(*bad).first().asDict()


def label(df: DataFrame, config: RecurrenceConfig | None = None, order: str = "_ord", strict: bool = False) -> DataFrame:
    """``df`` with recurrence_group_key, is_recurring and five more recurrence columns on every row.

    A group's reference amount is that of its first row by ``order``. Gaps are whole days of elapsed time between
    neighbouring timestamps. A popular merchant makes one group of many accounts, so no rows are sorted: gaps within a day are zeros, and those
    between days come from each day's first and last timestamp. Groups are aggregated once and joined back. With
    ``strict`` rows without timestamp or amount are an error.
    """
    config = (config or RecurrenceConfig()).checked()
    missing = [c for c in (*NEEDED, order) if c not in df.columns]
    if missing:
        raise RecurrenceInputError(f"columns {missing} are missing; there are {sorted(df.columns)}")
    if strict and any(found := invalid_counts(df).values()):
        raise RecurrenceInputError(f"rows without timestamp or amount: {found}")
    parts = ["merchant_mapped", "category_mapped", "subcategory_mapped", "direction"] + ["account_id"] * config.by_account
    new = ("recurrence_group_key", "is_recurring", "recurrence_cadence", "recurrence_confidence", "recurrence_occurrence_count", "recurrence_interval_days", "recurrence_amount_reference")
    keyed = df.drop(*new).withColumn("recurrence_group_key", F.concat_ws("|", *(text.match_form(F.col(c)) for c in parts)))

    slim = keyed.select("recurrence_group_key", F.col(order).alias("_o"), F.col("timestamp").cast("timestamp").alias("_ts"), money.not_nan(F.col("amount").cast("double")).alias("_amount"))
    micros = F.unix_micros("_ts")
    # neighbours on one day are less than a day apart, so their gaps are zeros that only need a count: no rows are sorted, and tasks combine a day's rows before any shuffle
    days = slim.groupBy("recurrence_group_key", F.call_function("div", micros - F.pmod(micros, F.lit(DAY_MICROS)), F.lit(DAY_MICROS)).alias("_day")).agg(
        F.count("*").alias("_n"), F.greatest(F.count("_ts") - 1, F.lit(0)).alias("_gaps"), F.min("_ts").alias("_from"), F.max("_ts").alias("_to"),
        F.min(F.struct("_o", "_amount")).alias("_first"), F.min("_amount").alias("_least"), F.max("_amount").alias("_most"),
    )
    zero = F.when(F.col("_gaps") > 0, F.lit(0))
    # a row for each group and day from here on
    by_day = Window.partitionBy("recurrence_group_key").orderBy("_day")
    groups = days.withColumn("_gap", _gap(F.col("_from"), F.lag("_to").over(by_day))).groupBy("recurrence_group_key").agg(
        F.sum("_n").alias("_n"), (F.sum("_gaps") + F.count("_gap")).alias("_gaps"), F.min(F.least(zero, "_gap")).alias("_low"), F.max(F.greatest(zero, "_gap")).alias("_high"),
        F.coalesce(F.sum("_gap"), F.lit(0)).alias("_sum"), F.min("_first")["_amount"].alias("_ref"), F.min("_least").alias("_least"), F.max("_most").alias("_most"),
    )

    def apart(value: str) -> Column:
        """Beyond both tolerances; the amount farthest on either side decides for the group."""
        d = F.abs(F.col(value) - F.col("_ref"))
        base = F.abs("_ref") if config.absolute_reference else F.col("_ref")
        return F.coalesce((d > config.difference) & (F.when(F.col("_ref") != 0, d / base).otherwise(d) > config.ratio), F.lit(False))

    n, gaps, low, high = F.col("_n"), F.col("_gaps"), F.col("_low"), F.col("_high")
    judged = (
        groups.withColumn("_steady", ~(apart("_least") | apart("_most")))
        .withColumn("recurrence_cadence", _cadence(config, gaps, low, high))
        .withColumn("recurrence_confidence", _confidence(config, n, gaps, low, high, F.col("_steady")))
        .select(
            F.col("recurrence_group_key"),
            ((n >= config.min_group) & (F.col("recurrence_cadence") != "none") & F.col("_steady")).alias("is_recurring"),
            "recurrence_cadence", "recurrence_confidence", n.alias("recurrence_occurrence_count"),
            F.when(gaps > 0, F.col("_sum") / gaps).otherwise(0.0).alias("recurrence_interval_days"), F.col("_ref").alias("recurrence_amount_reference"),
        )
    )
    return keyed.join(judged, "recurrence_group_key").select(*df.drop(*new).columns, *new)


def summary(df: DataFrame) -> DataFrame:
    """One row: total, recurring and other rows, and rows by cadence and by confidence."""
    cadence, confidence = F.coalesce("recurrence_cadence", F.lit("none")), F.coalesce("recurrence_confidence", F.lit("low"))
    yes = F.coalesce(F.col("is_recurring"), F.lit(False))
    return df.agg(
        F.count("*").alias("total_rows"), F.count_if(yes).alias("recurring_rows"), F.count_if(~yes).alias("other_rows"),
        *(F.count_if(cadence == c).alias(f"cadence_{c}") for c in fixed.CADENCES), *(F.count_if(confidence == c).alias(f"confidence_{c}") for c in fixed.CONFIDENCES),
    )
