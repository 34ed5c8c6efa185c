from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brasstally.functions import money, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("  a \t b\u00a0", "a b"), ("", None), (" \n", None), (None, None), ("x", "x")])
def test_clean(spark, raw, want):
    assert one(spark, raw, text.clean) == want


@pytest.mark.parametrize(("raw", "want"), [("Cedis", "GHS"), ("gbp", "GBP"), ("jpy", "JPY"), ("x", "X"), ("toolong", "TOOLONG"), (None, None), (" ", None)])
def test_currency(spark, raw, want):
    assert one(spark, raw, text.currency) == want


def test_currency_default(spark):
    f = lambda c: text.currency(c, "usd")
    assert [one(spark, v, f) for v in (None, "toolong", "eur", "jpy")] == ["USD", "USD", "EUR", "JPY"]


@pytest.mark.parametrize(("raw", "want"), [("shop-rite & co/7eleven éclair", "Shop-Rite & Co/7Eleven Éclair"), ("!!!", None), ("a*b  c", "Ab C"), (None, None)])
def test_merchant(spark, raw, want):
    assert one(spark, raw, text.merchant) == want


def test_categories_items_accounts(spark):
    assert one(spark, " Supermarket ", text.category) == "groceries"
    assert one(spark, "Food & Drink", text.category) == "food and drink"
    assert one(spark, "Charges", text.item_type) == "fee"
    assert one(spark, "Checking", text.account_type) == "current"
    assert one(spark, "Business", text.account_type) == "business"
    assert one(spark, None, text.match_form) == ""


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abZ é'-/7 _", min_size=1, max_size=12), min_size=1, max_size=20))
def test_title_like_python(spark, words):
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, x string").orderBy("i").select(text.title(F.col("x"))).collect()]
    assert got == [w.title() for w in words]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9).map(lambda v: round(v, 3)), min_size=1, max_size=30))
def test_amount_like_decimal(spark, values):
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(money.amount(F.col("x"))).collect()]
    assert got == [Decimal(str(v)).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN) for v in values]


def test_money_edges(spark):
    assert [one(spark, v, money.amount, "double") for v in (0.125, 2.675, -0.125, float("nan"), None, 1e20)] == [Decimal("0.12"), Decimal("2.68"), Decimal("-0.12"), None, None, None]
    assert [one(spark, v, money.number) for v in ("£1,234.50", "(12.5)", "1e3", " 7 ", "nan", None)] == [1234.5, None, 1000.0, 7.0, None, None]
    assert [one(spark, v, money.direction, "double") for v in (-1.0, 2.0, 0.0, float("nan"), None)] == ["debit", "credit", None, None, None]


def test_mean_rounds_once(spark):
    rows = [("1.00",)] * 24874 + [("2.00",)] * 125 + [("1.01",)]
    df = spark.createDataFrame(rows, "s string").select(F.col("s").cast("decimal(18,2)").alias("x"))
    total = sum(Decimal(r[0]) for r in rows)
    assert df.agg(money.mean(F.col("x"))).first()[0] == (total / len(rows)).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN)
    assert df.limit(0).agg(money.mean(F.col("x"))).first()[0] == Decimal("0.00")


def test_iso(spark):
    f = lambda c: text.iso_utc(c.cast("timestamp"))
    assert one(spark, "2026-03-05 10:15:30", f) == "2026-03-05T10:15:30+00:00"
    assert one(spark, "2026-03-05 10:15:30.5", f) == "2026-03-05T10:15:30.500000+00:00"
