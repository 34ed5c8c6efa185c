"""Requests to the query tools: validated values that become column predicates."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields
from datetime import datetime
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from brasstally.errors import InputError, LookupInputError, RecurringInputError, SpendInputError
from brasstally.functions import fixed, money, text

# What requests may name.
SPEND_DIRECTIONS = (*fixed.DIRECTIONS, "momo")
GROUPINGS = ("category", "subcategory", "merchant", "account", "currency", "month")
LOOKUP_SORTS = ("timestamp", "amount", "merchant", "category", "account_id", "transaction_id")
RECURRING_SORTS = ("last_seen_timestamp", "first_seen_timestamp", "average_amount", "merchant", "cadence", "confidence")


def names(values: str | Iterable[str] | None, lower: bool = False, error: type[InputError] = InputError) -> tuple[str, ...]:
    """Stripped names without blank ones; one string stands for itself."""
    if values is None:
        return ()
    listed = (values,) if isinstance(values, str) else tuple(values)
    if any(not isinstance(v, str) for v in listed):
        raise error(f"names must be strings: {listed!r}")
    kept = tuple(v.strip() for v in listed if v.strip())
    return tuple(v.lower() for v in kept) if lower else kept


def flag(value: object, error: type[InputError] = InputError) -> bool:
    """true, yes, 1 and false, no, 0 in any case, or a boolean."""
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    if word in ("true", "yes", "1"):
        return True
    if word in ("false", "no", "0"):
        return False
    raise error(f"not a boolean: {value!r}")


def bound(value: object, error: type[InputError] = InputError) -> Decimal | None:
    """An amount of two decimals, rounded half to even."""
    if value is None:
        return None
    try:
        return Decimal(str(value)).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN)
    except InvalidOperation as e:
        raise error(f"not an amount: {value!r}") from e


class _Request:
    error: type[InputError] = InputError

    def __post_init__(self):
        for f in fields(self):
            if f.type == "tuple[str, ...]":
                object.__setattr__(self, f.name, names(getattr(self, f.name), f.name in getattr(self, "lowered", ()), self.error))
        self._among("direction", self.directions, optional=True)
        if isinstance(self.limit, bool) or not isinstance(self.limit, int) or self.limit < 1:
            raise self.error(f"limit must be a whole number from 1 on: {self.limit!r}")
        if self.start and self.end and self.start > self.end:
            raise self.error(f"start {self.start} is after end {self.end}")

    def _among(self, name: str, allowed: Iterable[str], optional: bool = False) -> None:
        value = getattr(self, name)
        if value is None and optional:
            return
        if value not in allowed:
            raise self.error(f"{name} must be one of {tuple(allowed)}: {value!r}")

    def in_range(self, by_month: bool = False) -> list[Column]:
        """Both ends belong to the range; a date alone means its midnight. ``by_month`` also bounds the column that stored tables are partitioned by."""
        def instant(v: str) -> Column:
            try:
                datetime.fromisoformat(v.replace("Z", "+00:00"))
            except ValueError as e:
                raise self.error(f"not a timestamp: {v!r}") from e
            return F.lit(v).cast("timestamp")

        ends = [(instant(self.start), Column.__ge__)] if self.start else []
        ends += [(instant(self.end), Column.__le__)] if self.end else []
        months = [compare(F.col("month"), F.date_format(at, "yyyy-MM")) for at, compare in ends] if by_month else []
        return [compare(F.col("timestamp"), at) for at, compare in ends] + months

    def echo(self) -> dict:
        """The request's values, as they apply; user_id is only repeated."""
        return {f.name: (str(v) if isinstance(v := getattr(self, f.name), Decimal) else v) for f in fields(self)}


def _isin(column: str, values: tuple[str, ...]) -> list[Column]:
    return [F.col(column).isin(*values)] if values else []


def _folded(column: str, values: tuple[str, ...]) -> list[Column]:
    return [text.match_form(F.col(column)).isin(*values)] if values else []


@dataclass(frozen=True)
class LookupRequest(_Request):
    user_id: str | None = None
    transaction_ids: tuple[str, ...] = ()
    account_ids: tuple[str, ...] = ()
    merchants: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    direction: str | None = None
    start: str | None = None
    end: str | None = None
    min_amount: Decimal | None = None
    max_amount: Decimal | None = None
    sort_by: str = "timestamp"
    descending: bool = True
    limit: int = 25
    error = LookupInputError
    directions = fixed.DIRECTIONS

    def __post_init__(self):
        super().__post_init__()
        self._among("sort_by", LOOKUP_SORTS)
        for name in ("min_amount", "max_amount"):
            object.__setattr__(self, name, bound(getattr(self, name), self.error))
        if self.min_amount is not None and self.max_amount is not None and self.min_amount > self.max_amount:
            raise self.error(f"min_amount {self.min_amount} is above max_amount {self.max_amount}")

    def predicates(self, by_month: bool = False) -> list[Column]:
        out = _isin("transaction_id", self.transaction_ids) + _isin("account_id", self.account_ids) + _isin("merchant", self.merchants) + _isin("category", self.categories)
        out += _isin("direction", (self.direction,) if self.direction else ()) + self.in_range(by_month)
        amount = money.amount(F.col("amount"))
        return out + ([amount >= F.lit(self.min_amount)] if self.min_amount is not None else []) + ([amount <= F.lit(self.max_amount)] if self.max_amount is not None else [])


@dataclass(frozen=True)
class SpendRequest(_Request):
    user_id: str | None = None
    account_ids: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    merchants: tuple[str, ...] = ()
    direction: str = "debit"
    start: str | None = None
    end: str | None = None
    group_by: str | None = None
    limit: int = 10
    descending: bool = True
    absolute: bool = False
    error = SpendInputError
    directions = SPEND_DIRECTIONS

    def __post_init__(self):
        super().__post_init__()
        self._among("direction", SPEND_DIRECTIONS)
        self._among("group_by", GROUPINGS, optional=True)

    def predicates(self, by_month: bool = False) -> list[Column]:
        return _isin("account_id", self.account_ids) + self.in_range(by_month) + _isin("category", self.categories) + _isin("merchant", self.merchants) + [F.col("direction") == self.direction]


@dataclass(frozen=True)
class RecurringRequest(_Request):
    """Names but account ids are compared in lower case."""

    user_id: str | None = None
    account_ids: tuple[str, ...] = ()
    merchants: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    cadences: tuple[str, ...] = ()
    confidences: tuple[str, ...] = ()
    direction: str | None = "debit"
    start: str | None = None
    end: str | None = None
    include_irregular: bool = True
    sort_by: str = "last_seen_timestamp"
    descending: bool = True
    limit: int = 25
    error = RecurringInputError
    directions = fixed.DIRECTIONS
    lowered = ("merchants", "categories", "cadences", "confidences")

    def __post_init__(self):
        super().__post_init__()
        self._among("sort_by", RECURRING_SORTS)
        object.__setattr__(self, "include_irregular", flag(self.include_irregular, self.error))
        for values, allowed in ((self.cadences, fixed.CADENCES[1:]), (self.confidences, fixed.CONFIDENCES)):
            if set(values) - set(allowed):
                raise self.error(f"{values} must be among {allowed}")

    def predicates(self, by_month: bool = False) -> list[Column]:
        out = [F.coalesce(F.col("is_recurring"), F.lit(False))]
        if not self.include_irregular:
            out.append(text.match_form(F.col("recurrence_cadence")) != "irregular")
        out += _isin("account_id", self.account_ids) + _folded("merchant", self.merchants) + _folded("category", self.categories)
        out += _folded("recurrence_cadence", self.cadences) + _folded("recurrence_confidence", self.confidences)
        return out + _folded("direction", (self.direction,) if self.direction else ()) + self.in_range(by_month)
