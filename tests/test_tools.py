import datetime as dt
from decimal import Decimal

import pytest

from brasstally.errors import ExplainInputError, LookupInputError, RecurringInputError, SpendInputError
from brasstally.operators import explain, tools
from brasstally.plans.requests import LookupRequest, RecurringRequest, SpendRequest, flag, names

SCHEMA = "transaction_id string, account_id string, timestamp timestamp, amount double, currency string, direction string, merchant string, category string, subcategory string, is_recurring boolean, recurrence_cadence string, recurrence_confidence string"


def row(i, amount=-5.0, day=1, currency="GHS", direction="debit", merchant="m", category="cash", account="ACC_1", recurring=True, cadence="weekly", confidence="high", hour=0):
    return (i, account, dt.datetime(2026, 3, day, hour), amount, currency, direction, merchant, category, "general", recurring, cadence, confidence)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [row("a", -5.0), row("b", -50.0, 2, merchant="n"), row("c", 0.125, 3, direction="credit"), row("d", -5.0, 20, "USD", hour=10), row("e", -7.0, 4, category=" ", recurring=None), row("f", -1.0, 5, cadence="irregular", confidence="low", merchant="M")]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r.transaction_id for r in df.collect()]


def test_lookup(frame):
    assert ids(tools.lookup(frame, LookupRequest())) == ["d", "f", "e", "c", "b", "a"]
    assert ids(tools.lookup(frame, LookupRequest(sort_by="amount", descending=True, limit=3))) == ["c", "f", "a"]
    assert ids(tools.lookup(frame, LookupRequest(merchants="m", direction="debit", descending=False))) == ["a", "e", "d"]
    assert ids(tools.lookup(frame, LookupRequest(end="2026-03-20"))) == ["f", "e", "c", "b", "a"]
    assert ids(tools.lookup(frame, LookupRequest(min_amount="0.121", max_amount=1))) == ["c"]
    assert tools.lookup(frame, LookupRequest(transaction_ids=("c",))).first().amount == Decimal("0.12")
    assert ids(tools.lookup(frame, LookupRequest(account_ids=["acc_1"]))) == []


def test_lookup_plan(frame):
    plan = tools.lookup(frame, LookupRequest())._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_filters_reach_the_scan(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "t"))
    df = tools.lookup(spark.read.parquet(str(tmp_path / "t")), LookupRequest(merchants=("m",), start="2026-03-01"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(merchant,m)" in plan or "In(merchant" in plan
    assert "GreaterThanOrEqual(timestamp" in plan


def test_requests():
    assert names(" a ") == ("a",) and names(["b", " "], lower=True) == ("b",) and names(None) == ()
    assert flag("YES") and not flag("0")
    for bad in (dict(limit=0), dict(limit=True), dict(sort_by="x"), dict(direction="momo"), dict(start="2026-02", end="2026-01"), dict(min_amount=2, max_amount=1), dict(merchants=(1,)), dict(min_amount="x")):
        with pytest.raises(LookupInputError):
            LookupRequest(**bad)
    with pytest.raises(SpendInputError):
        SpendRequest(group_by="day")
    assert SpendRequest(direction="momo").echo()["direction"] == "momo"
    with pytest.raises(RecurringInputError):
        RecurringRequest(cadences=("daily",))
    with pytest.raises(RecurringInputError):
        RecurringRequest(include_irregular="maybe")


def test_strict(spark):
    bad = spark.createDataFrame([row("a", float("nan"), currency=" ")], SCHEMA)
    with pytest.raises(LookupInputError):
        tools.lookup(bad, LookupRequest(), strict=True)
    with pytest.raises(SpendInputError):
        tools.spend_total(bad, SpendRequest(), strict=True)


def test_spend(frame):
    total = tools.spend_total(frame, SpendRequest()).first()
    assert (total.total_amount, total.transaction_count, total.currencies, total.warnings) == (Decimal("-68.00"), 5, 2, [tools.MIXED_SPEND])
    assert tools.spend_total(frame, SpendRequest(direction="momo")).first().total_amount == Decimal("0.00")
    groups = tools.spend_grouped(frame, SpendRequest(group_by="category")).collect()
    assert [(g.key, g.total_amount, g.transaction_count, g.currency) for g in groups] == [("unknown", Decimal("-7.00"), 1, "GHS"), ("cash", Decimal("-61.00"), 4, None)]
    assert [g.key for g in tools.spend_grouped(frame, SpendRequest(group_by="category", absolute=True)).collect()] == ["cash", "unknown"]
    assert [g.key for g in tools.spend_grouped(frame, SpendRequest(group_by="month")).collect()] == ["2026-03"]
    assert {r.currency: r.total_amount for r in tools.spend_by_currency(frame, SpendRequest()).collect()} == {"GHS": Decimal("-63.00"), "USD": Decimal("-5.00")}


def test_recurring(frame):
    got = tools.recurring_streams(frame, RecurringRequest()).collect()
    assert [(g.merchant, g.transaction_count, g.currency, g.is_irregular) for g in got] == [("m", 2, None, False), ("M", 1, "GHS", True), ("n", 1, "GHS", False)]
    assert got[0].average_amount == Decimal("-5.00")
    assert [g.merchant for g in tools.recurring_streams(frame, RecurringRequest(include_irregular=False, merchants=("N",))).collect()] == ["n"]
    assert len(tools.recurring_streams(frame, RecurringRequest(account_ids=("ACC_1",))).collect()) == 3
    records = tools.recurring_streams(frame, RecurringRequest())
    assert {(r.measure, r.value): r.n for r in tools.recurring_summary(records).collect()}[("currency", "mixed")] == 1
    assert tools.recurring_warnings(records).first().warnings == [tools.MIXED_RECURRING]
    assert tools.recurring_warnings(records.limit(0)).first().warnings == [tools.NO_RECURRING]
    assert tools.recurring_warnings(records.where("is_irregular")).first().warnings == [tools.ALL_IRREGULAR]


def test_warnings_and_json(frame):
    assert tools.lookup_warnings(tools.lookup(frame, LookupRequest())).first().warnings == [tools.MIXED_LOOKUP]
    assert tools.lookup_warnings(frame.limit(0)).first().warnings == [tools.NO_LOOKUP]
    one = tools.to_json(tools.lookup(frame, LookupRequest(transaction_ids="c"))).first().record
    assert '"amount":"0.12"' in one and '"timestamp":"2026-03-03T00:00:00+00:00"' in one


def test_explanations(frame):
    request = SpendRequest(group_by="category")
    blocks = explain.spend(tools.spend_total(frame, request), tools.spend_grouped(frame, request), "low", "my_view").orderBy("place").collect()
    assert [(b.title, b.value, b.priority) for b in blocks] == [("Total spend", "-68.00", 4), ("My View: unknown", "-7.00", 1)]
    assert blocks[0].context == "Based on 5 transaction(s) across 2 currencies" and blocks[0].tags == ["multi_currency"]
    records = tools.lookup(frame, LookupRequest())
    blocks = explain.transactions(records, "high").orderBy("place").collect()
    assert [b.title for b in blocks] == ["Largest returned transaction", "Most recent returned transaction", "Transaction: m", "Transaction: M", "Transaction: m", "Transaction: m"]
    assert blocks[2].tags == ["recent_activity"] and blocks[0].value == "0.12"
    streams = tools.recurring_streams(frame, RecurringRequest())
    blocks = explain.recurring(streams).orderBy("place").collect()
    assert blocks[0].title == "Primary recurring payment" and blocks[0].value == "-1.00"
    assert blocks[-1].value == "irregular: 1 | weekly: 2"
    assert len(explain.recurring(streams, "low").collect()) == 2
    assert explain.transactions(records.limit(0)).count() == 0 and explain.recurring(streams.limit(0)).count() == 0
    assert explain.transaction_flags(records).first().largest_transaction_id == "c"
    flags = explain.spend_flags(tools.spend_total(frame, request), tools.spend_grouped(frame, request)).first()
    assert flags.top_group_key == "unknown" and flags.multi_currency and flags.has_groups
    assert explain.recurring_flags(streams).first().high_confidence_count == 2


def test_explanation_rules(spark, frame):
    assert explain.confidence({"high": 0, "medium": 2}, ()) == "medium" and explain.confidence(None, ("w",)) == "medium" and explain.confidence(None, ()) == "high"
    with pytest.raises(ExplainInputError):
        explain.check_source(frame, "balance")
    with pytest.raises(ExplainInputError):
        explain.check_source(spark.range(1), "spend")
    with pytest.raises(ExplainInputError):
        explain.block("t", " ", "", (), 1)
    with pytest.raises(ExplainInputError):
        explain.block("t", "v", "", ("odd",), 1)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([" a ", "b"], ["a", " "])], "x array<string>, y array<string>")
    assert df.select(explain.merged_warnings(F.col("x"), F.col("y"))).first()[0] == ["a", "b"]
    assert df.select(explain.merged_warnings(F.col("x"), include=False)).first()[0] == []
