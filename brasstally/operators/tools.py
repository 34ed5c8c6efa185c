"""The query tools: transaction lookup, spend summaries and recurring payments."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasstally.errors import InputError
from brasstally.functions import money, text
from brasstally.functions.fixed import ALL_IRREGULAR, MIXED_LOOKUP, MIXED_RECURRING, MIXED_SPEND, NO_LOOKUP, NO_RECURRING
from brasstally.plans.requests import LookupRequest, RecurringRequest, SpendRequest, _Request
from brasstally.plans.within import within

COLUMNS = ("transaction_id", "account_id", "timestamp", "amount", "currency", "direction", "merchant", "category", "subcategory")
RECURRING_COLUMNS = (*COLUMNS, "is_recurring", "recurrence_cadence", "recurrence_confidence")


def _need(df: DataFrame, columns: tuple[str, ...], error: type[InputError]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise error(f"columns {missing} are missing; there are {sorted(df.columns)}")


#: Tables of ids for columns, besides a request's own names; see ``plans.within``.
Tables = Mapping[str, DataFrame] | None


def filtered(df: DataFrame, request: _Request, tables: Tables = None) -> DataFrame:
    """All predicates at once, on raw columns where they are exact, so that they reach the scan; a column ``month`` (of a stored table) is bounded, too.

    ``tables`` names columns whose values must be in a table."""
    return within(df.where(reduce(lambda a, b: a & b, request.predicates("month" in df.columns), F.lit(True))), tables, request.error)


def strict_check(df: DataFrame, error: type[InputError], blank: tuple[str, ...] = ("currency",)) -> None:
    """One aggregate over the rows: an error if any lacks a timestamp, an amount or one of ``blank``."""
    bad = [F.count_if(F.col("timestamp").isNull()).alias("timestamp"), F.count_if(money.amount(F.col("amount")).isNull()).alias("amount"), *(F.count_if(text.is_blank(F.col(c))).alias(c) for c in blank)]
    found = {k: v for k, v in df.agg(*bad).first().asDict().items() if v}
    if found:
        raise error(f"rows without a value: {found}")


def _ordered(c: Column, descending: bool) -> Column:
    return c.desc() if descending else c.asc()


def lookup(df: DataFrame, request: LookupRequest, strict: bool = False, tables: Tables = None) -> DataFrame:
    """Records of the rows that match, sorted, at most ``limit``; equal ones by ascending id."""
    _need(df, COLUMNS, request.error)
    rows = filtered(df, request, tables)
    if strict:
        strict_check(rows, request.error)
    key = {"timestamp": F.col("timestamp"), "amount": money.amount(F.col("amount"))}.get(request.sort_by, text.match_form(F.col(request.sort_by)))
    out = rows.orderBy(_ordered(key, request.descending), F.asc("transaction_id")).limit(request.limit)
    kept = {c: text.strip(F.col(c).cast("string")).alias(c) for c in COLUMNS if c not in ("timestamp", "amount")}
    return out.select(*(kept.get(c, money.amount(F.col(c)).alias(c) if c == "amount" else F.col(c)) for c in COLUMNS))


def _key(group_by: str) -> Column:
    if group_by == "month":
        # a month for rows without a time would be a guess
        return F.when(F.col("timestamp").isNull(), F.raise_error(F.lit("rows without a timestamp can't be grouped by month"))).otherwise(F.date_format("timestamp", "yyyy-MM"))
    raw = text.clean(F.col("account_id" if group_by == "account" else group_by))
    return F.coalesce(raw, F.lit("unknown"))


def spend_total(df: DataFrame, request: SpendRequest, strict: bool = False, tables: Tables = None) -> DataFrame:
    """One row: total_amount, transaction_count, currencies and warnings."""
    _need(df, COLUMNS, request.error)
    rows = filtered(df, request, tables)
    if strict:
        strict_check(rows, request.error)
    currencies = F.count_distinct(text.strip(F.col("currency")))
    return rows.agg(money.total(_amount(request)).alias("total_amount"), F.count("*").alias("transaction_count"), currencies.alias("currencies"), F.array_compact(F.array(F.when(currencies > 1, F.lit(MIXED_SPEND)))).alias("warnings"))


def _amount(request: SpendRequest) -> Column:
    amount = money.amount(F.col("amount"))
    return F.abs(amount) if request.absolute else amount


def spend_by_currency(df: DataFrame, request: SpendRequest, tables: Tables = None) -> DataFrame:
    """Total and count of each currency; a blank currency is an error when the rows are read."""
    _need(df, COLUMNS, request.error)
    code = text.strip(F.col("currency"))
    code = F.when(code == "", F.raise_error(F.lit("rows have a blank currency"))).otherwise(code)
    return filtered(df, request, tables).groupBy(code.alias("currency")).agg(money.total(_amount(request)).alias("total_amount"), F.count("*").alias("transaction_count"))


def spend_grouped(df: DataFrame, request: SpendRequest, tables: Tables = None) -> DataFrame:
    """rank, key, total_amount, transaction_count and currency (null where several) of the leading groups.

    Sorted by total, count and lower-case key, all in the request's direction.
    """
    _need(df, COLUMNS, request.error)
    if not request.group_by:
        raise request.error("group_by is missing")
    currency = text.strip(F.col("currency"))
    groups = filtered(df, request, tables).groupBy(_key(request.group_by).alias("key")).agg(
        money.total(_amount(request)).alias("total_amount"), F.count("*").alias("transaction_count"), F.when(F.min(currency) == F.max(currency), F.min(currency)).alias("currency"),
    )
    order = [_ordered(c, request.descending) for c in (F.col("total_amount"), F.col("transaction_count"), F.lower("key"))] + [F.asc("key")]
    return groups.orderBy(*order).limit(request.limit)


STREAM = ("merchant", "category", "subcategory", "account_id", "direction", "recurrence_cadence", "recurrence_confidence")


def recurring_streams(df: DataFrame, request: RecurringRequest, strict: bool = False, tables: Tables = None) -> DataFrame:
    """Recurring payments with counts, first and last time, average amount and currency, sorted, at most ``limit``."""
    _need(df, RECURRING_COLUMNS, request.error)
    rows = filtered(df, request, tables)
    if strict:
        strict_check(rows, request.error)
    currency = text.clean(F.col("currency"))
    streams = rows.groupBy(*(text.strip(F.col(c)).alias(c) for c in STREAM)).agg(
        F.count("*").alias("transaction_count"), F.min("timestamp").alias("first_seen_timestamp"), F.max("timestamp").alias("last_seen_timestamp"),
        money.mean(money.amount(F.col("amount"))).alias("average_amount"), F.when(F.min(currency) == F.max(currency), F.min(currency)).alias("currency"),
    )
    low = {"direction": "direction", "recurrence_cadence": "cadence", "recurrence_confidence": "confidence"}
    out = streams.select(*(F.lower(c).alias(low[c]) if c in low else F.col(c) for c in STREAM), "transaction_count", "first_seen_timestamp", "last_seen_timestamp", "average_amount", "currency").withColumn("is_irregular", F.col("cadence") == "irregular")
    names = [F.lower("merchant"), F.lower("account_id")]
    order = [*names, F.col("last_seen_timestamp")] if request.sort_by == "merchant" else [F.col(request.sort_by), *names]
    total = [F.asc(c) for c in ("merchant", "category", "subcategory", "account_id", "direction", "cadence", "confidence")]
    return out.orderBy(*(_ordered(c, request.descending) for c in order), *total).limit(request.limit)


def recurring_summary(records: DataFrame) -> DataFrame:
    """measure, value and n: records by cadence, confidence and currency (null as ``mixed``)."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(c), F.lit("mixed")).alias("value")) for m, c in (("cadence", "cadence"), ("confidence", "confidence"), ("currency", "currency"))))
    return records.select(F.explode(pairs).alias("p")).groupBy("p.measure", "p.value").agg(F.count("*").alias("n"))


def lookup_warnings(records: DataFrame) -> DataFrame:
    several = F.count_distinct("currency") > 1
    return records.agg(F.array_compact(F.array(F.when(F.count("*") == 0, NO_LOOKUP), F.when(several, MIXED_LOOKUP))).alias("warnings"))


def recurring_warnings(records: DataFrame) -> DataFrame:
    n = F.count("*")
    mixed = (F.count_distinct("currency") > 1) | (F.count_if(F.col("currency").isNull()) > 0)
    irregular = (n > 0) & (F.count_if(F.col("is_irregular")) == n)
    return records.agg(F.array_compact(F.array(F.when(n == 0, NO_RECURRING), F.when((n > 0) & mixed, MIXED_RECURRING), F.when(irregular, ALL_IRREGULAR))).alias("warnings"))


def to_json(records: DataFrame) -> DataFrame:
    """Each record as one JSON string: amounts as strings, timestamps in ISO 8601."""
    shaped = [text.iso_utc(F.col(c)).alias(c) if t.startswith("timestamp") else F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in records.dtypes]
    return records.select(F.to_json(F.struct(*shaped)).alias("record"))
