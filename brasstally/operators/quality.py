"""Data-quality findings: the processed transactions are evaluated once, all else reads the slim rows that this gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasstally.errors import QualityInputError
from brasstally.functions import fixed, money, text
from brasstally.plans.shared import kept

NEEDED = (
    "transaction_id", "timestamp", "amount", "direction", "merchant_mapped", "category_mapped", "subcategory_mapped", "category_mapping_source",
    "is_recurring", "recurrence_cadence", "recurrence_confidence", "recurrence_group_key", "recurrence_occurrence_count",
)
NEVER_NULL = NEEDED[:11]


@dataclass(frozen=True)
class QualityConfig:
    """Domains and limits. ``min_occurrences`` is what a recurring row needs; by default the number of samples."""

    samples: int = 5
    directions: tuple[str, ...] = fixed.DIRECTIONS
    categories: tuple[str, ...] = fixed.CATEGORIES
    subcategories: tuple[str, ...] = fixed.SUBCATEGORIES
    cadences: tuple[str, ...] = fixed.CADENCES
    confidences: tuple[str, ...] = fixed.CONFIDENCES
    earliest: str = "2000-01-01"
    allow_future: bool = False
    min_occurrences: int | None = None


def _checks(config: QualityConfig, now: str) -> list[tuple[str, str, str, Column]]:
    """(name, severity, message, condition of a bad row) in the order of the report."""
    ts, amount = F.col("timestamp").try_cast("timestamp"), money.not_nan(F.col("amount").try_cast("double"))
    recurring = F.coalesce(F.col("is_recurring"), F.lit(False))
    floor = config.samples if config.min_occurrences is None else config.min_occurrences
    domains = (("direction", config.directions), ("category_mapped", config.categories), ("subcategory_mapped", config.subcategories), ("recurrence_cadence", config.cadences), ("recurrence_confidence", config.confidences))
    # ids that occur more than once are counted over all rows, not here
    found = [("duplicate_transaction_id", "error", "Transaction ids occur more than once.", F.lit(False))]
    found += [(f"null_{c}", "error", f"{c} is null.", F.col(c).isNull()) for c in NEVER_NULL]
    found += [(f"enum_{c}", "error", f"{c} is outside its domain.", ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))) for c, allowed in domains if allowed]
    found += [
        ("timestamp_unparseable", "error", "Timestamps have no value.", ts.isNull()),
        ("timestamp_too_early", "error", f"Timestamps are before {config.earliest}.", ts < F.lit(config.earliest).cast("timestamp")),
    ]
    if not config.allow_future:
        found.append(("timestamp_future", "warning", "Timestamps are in the future.", ts > F.lit(now).cast("timestamp")))
    found += [
        ("amount_not_numeric", "error", "Amounts aren't numbers.", amount.isNull()),
        ("amount_not_positive", "warning", "Amounts are zero or negative.", amount <= 0),
        ("recurring_without_group", "error", "Recurring rows have no group.", recurring & text.is_blank(F.col("recurrence_group_key"))),
        ("recurring_too_few", "error", f"Recurring rows have fewer than {floor} occurrences.", recurring & (F.col("recurrence_occurrence_count") < floor)),
        ("not_recurring_but_labelled", "warning", "Rows that aren't recurring have a cadence or confidence.", ~recurring & (~F.col("recurrence_cadence").eqNullSafe(F.lit("none")) | ~F.col("recurrence_confidence").eqNullSafe(F.lit("low")))),
    ]
    return found


def findings(df: DataFrame, now: str, config: QualityConfig | None = None, order: str = "_ord") -> DataFrame:
    """place, check_name, severity, message, row_count and sample_ids of every check with bad rows.

    ``now`` is a parameter, so that a report can be repeated. Samples are the first ids by ``order``; only ``samples``
    rows of each check and partition reach the last step.
    """
    config = config or QualityConfig()
    missing = [c for c in (*NEEDED, order) if c not in df.columns]
    if missing:
        raise QualityInputError(f"columns {missing} are missing; there are {sorted(df.columns)}")
    checks = _checks(config, now)
    bad = F.array_compact(F.array(*(F.when(condition, F.lit(k)) for k, (*_, condition) in enumerate(checks))))
    slim = kept(df.select(F.col("transaction_id").cast("string").alias("id"), F.col(order).alias("o"), bad.alias("bad")))
    copies = slim.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_copies")).where("_copies > 1")
    repeated = slim.join(copies, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("id", "o", F.lit(0).alias("place"))
    hits = slim.select("id", "o", F.explode("bad").alias("place")).unionByName(repeated)
    twice = copies.agg(F.sum("_copies").alias("row_count")).where("row_count > 0").select(F.lit(0).alias("place"), "row_count")
    counts = slim.select(F.explode("bad").alias("place")).groupBy("place").agg(F.count("*").alias("row_count")).unionByName(twice)
    first = Window.partitionBy("place").orderBy("o", "id")
    samples = hits.withColumn("r", F.row_number().over(first)).where(F.col("r") <= config.samples).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("r", F.coalesce("id", F.lit("null")).alias("id")))).alias("s"))
    names = F.array(*(F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), F.lit(m).alias("message")) for n, s, m, _ in checks))
    return counts.join(samples, "place").withColumn("_c", F.get(names, F.col("place"))).select("place", "_c.*", "row_count", F.transform("s", lambda x: x["id"]).alias("sample_ids"))


def report(found: DataFrame) -> DataFrame:
    """One row: passed (no errors), errors, warnings, and the findings in order."""
    one = F.struct("place", "check_name", "severity", "message", "row_count", "sample_ids")
    return found.agg(
        (F.count_if(F.col("severity") == "error") == 0).alias("passed"), F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"), F.array_sort(F.collect_list(one)).alias("findings"),
    )


def report_to_dict(row_source: DataFrame) -> dict:
    """The report of ``report`` as plain values; it has a row for each check at most."""
    return row_source.first().asDict(recursive=True)
