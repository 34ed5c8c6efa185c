"""Exact amounts of two decimals, rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,2)"


def not_nan(c: Column) -> Column:
    """NaN as null: a missing number is null everywhere."""
    return F.nullif(c, F.lit(float("nan")))


def number(c: Column) -> Column:
    """A double from text such as ``£1,234.50``; null where it is none."""
    return not_nan(F.regexp_replace(c.cast("string"), "[,£$]", "").try_cast("double"))


def amount(c: Column) -> Column:
    """Two decimals; a plain cast would round half up. Null for what has no exact value."""
    return F.bround(c.try_cast("decimal(38,18)"), 2).try_cast(AMOUNT)


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(28,2)")).cast("decimal(28,2)")


def mean(c: Column) -> Column:
    """Sum by count, rounded once; ``avg`` would round before."""
    exact = F.sum(c).cast(AMOUNT) / F.count(c).cast("decimal(10,0)")
    return F.coalesce(F.bround(exact, 2).cast(AMOUNT), F.lit(0).cast(AMOUNT))


def direction(c: Column) -> Column:
    """debit below zero, credit above, else null."""
    value = not_nan(c.try_cast("double"))
    return F.when(value < 0, "debit").when(value > 0, "credit")
