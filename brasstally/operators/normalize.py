"""Canonical forms of the five datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasstally.errors import NormalizeError
from brasstally.functions import fixed, money, text


@dataclass(frozen=True)
class NormalizeConfig:
    default_currency: str | None = None
    drop_invalid_rows: bool = False


def _apply(df: DataFrame, changes: dict[str, Callable[[Column], Column]]) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c, f in changes.items() if c in df.columns})


def _required(df: DataFrame, columns: tuple[str, ...], config: NormalizeConfig) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.dropna(how="any", subset=present) if config.drop_invalid_rows and present else df


def transactions(df: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """Cleaned columns, and merchant_clean, date, month and direction."""
    for c in ("amount", "timestamp"):
        if c not in df.columns:
            raise NormalizeError(f"transactions need the column {c}; there are {sorted(df.columns)}")
    # a word that several branches look at is a column first, so that a row's texts are cleaned once
    words = {"currency": text.clean, "category": lambda c: text.category_word(text.clean(c)), "amount": lambda c: money.not_nan(c.try_cast("double"))}
    out = _apply(df, {c: text.clean for c in ("transaction_id", "account_id", "description", "merchant")} | words)
    merchant = text.without_marks(F.col("merchant")) if "merchant" in df.columns else F.lit(None).cast("string")
    found = {"currency": lambda c: text.currency_of(c, config.default_currency), "category": lambda c: text.known(c, fixed.BASE_CATEGORIES)}
    out = _apply(out.withColumn("merchant_clean", merchant), found | {"merchant_clean": text.clean})
    out = _apply(out, {"merchant_clean": text.title})
    out = out.withColumns({
        "date": F.date_format("timestamp", "yyyy-MM-dd"),
        "month": F.date_format("timestamp", "yyyy-MM"),
        "direction": money.direction(F.col("amount")),
    })
    return _required(out, ("transaction_id", "account_id", "amount", "currency", "timestamp"), config)


def accounts(df: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    out = _apply(df, {"account_id": text.clean, "account_name": text.clean, "account_type": text.account_type, "currency": lambda c: text.currency(c, config.default_currency)})
    return _required(out, ("account_id", "account_name"), config)


def fees_and_limits(df: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    out = _apply(df, {"item_id": text.clean, "item_type": text.item_type, "unit": text.upper, "notes": text.clean, "value": lambda c: money.not_nan(c.try_cast("double"))})
    return _required(out, ("item_id", "item_type", "value"), config)


def products(df: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    out = _apply(df, {"product_id": text.clean, "product_name": text.clean, "product_type": lambda c: F.lower(text.clean(c))})
    return _required(out, ("product_id", "product_name"), config)


def metadata(df: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    out = _apply(df, {"key": lambda c: F.lower(text.clean(c)), "value": text.clean, "source": text.clean})
    return _required(out, ("key", "value"), config)


DATASETS = {"transactions": transactions, "accounts": accounts, "fees_and_limits": fees_and_limits, "products": products, "metadata": metadata}


def bundle(tables: dict[str, DataFrame], config: NormalizeConfig = NormalizeConfig()) -> dict[str, DataFrame]:
    """Each known table in its canonical form; others as they are."""
    return {name: DATASETS[name](df, config) if name in DATASETS else df for name, df in tables.items()}
