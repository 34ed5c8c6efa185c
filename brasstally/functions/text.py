"""Text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from brasstally.functions import fixed


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (``trim`` knows the plain space only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def clean(c: Column) -> Column:
    """Stripped, inner white space as single spaces, blank as null."""
    return F.nullif(strip(collapse(c.cast("string"))), F.lit(""))


def is_blank(c: Column) -> Column:
    return clean(c).isNull()


def upper(c: Column) -> Column:
    return F.upper(clean(c))


def match_form(c: Column) -> Column:
    """The form in which values are compared: stripped, lower case, null as empty."""
    return F.coalesce(F.lower(strip(c.cast("string"))), F.lit(""))


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """The table's value, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def title(c: Column) -> Column:
    """Every run of letters capitalised, also after a hyphen or a digit."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), 0)
    return F.array_join(F.transform(runs, F.initcap), "")


def currency(c: Column, default: str | None = None) -> Column:
    """A code: known names by table, other words of 3 to 5 characters in capitals, else the default if there is one."""
    return currency_of(clean(c), default)


def currency_of(word: Column, default: str | None = None) -> Column:
    """The code for a cleaned word, which is best a column of its own: several branches look at it."""
    fallback = F.lit(default.strip().upper() if default and default.strip() else None).cast("string")
    known = lookup(F.lower(word), fixed.CURRENCIES)
    return F.when(word.isNull(), fallback).otherwise(F.coalesce(known, F.when(F.length(word).between(3, 5), F.upper(word)), fallback, F.upper(word)))


def merchant(c: Column) -> Column:
    return title(clean(without_marks(clean(c))))


def without_marks(word: Column) -> Column:
    return F.regexp_replace(word, r"(?U)[^\w\s&/\-]", "")


def category_word(word: Column) -> Column:
    """A cleaned category in the form in which the table has it; neither change makes white space."""
    return F.replace(F.lower(word), F.lit("&"), F.lit("and"))


def known(word: Column, table: Mapping[str, str]) -> Column:
    """The table's value, or the word, which is best a column of its own: both branches look at it."""
    return F.coalesce(lookup(word, table), word)


def category(c: Column) -> Column:
    return known(category_word(clean(c)), fixed.BASE_CATEGORIES)


def item_type(c: Column) -> Column:
    return known(F.lower(clean(c)), fixed.ITEM_TYPES)


def account_type(c: Column) -> Column:
    return known(F.lower(clean(c)), fixed.ACCOUNT_TYPES)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with offset; a fraction only if there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
