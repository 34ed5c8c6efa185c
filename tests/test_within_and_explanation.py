"""Filters by tables of ids on both sides of the size check, and whole explanations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brasstally.errors import ExplainInputError, InputError, LookupInputError
from brasstally.operators import explain, tools
from brasstally.plans import within as w
from brasstally.plans.requests import LookupRequest, RecurringRequest, SpendRequest

SCHEMA = "transaction_id string, account_id string, timestamp timestamp, amount double, currency string, direction string, merchant string, category string, subcategory string"


@pytest.fixture(scope="module")
def rows(spark):
    base = dt.datetime(2026, 3, 1)
    made = [(f"t{i}", f"a{i % 40}", base + dt.timedelta(hours=i), -1.25 * i, ("GHS", "USD")[i % 7 == 0], "debit", "uber" if i % 3 else "melcom", ("food", "fees")[i % 2], "x") for i in range(1, 600)] + [(None, "a1", base, -1.0, "GHS", "debit", "uber", "food", "x")]
    return spark.createDataFrame(made, SCHEMA)


def plan_of(df):
    plan = df._jdf.queryExecution().toString()
    return plan[plan.index("== Physical Plan ==") :]


@pytest.mark.parametrize("most,bits", [(10**6, 1 << 28), (0, 1 << 28), (0, 1 << 10), (0, 8)])
def test_ids_of_a_table(spark, rows, monkeypatch, most, bits):
    monkeypatch.setattr(w, "MOST_BROADCAST", most)
    monkeypatch.setattr(w, "MOST_BITS", bits)
    asked = [f" t{i} " for i in range(0, 900, 3)] + ["t3", None, "", "  ", "other"]
    ids = spark.createDataFrame([(x,) for x in asked], "any string")
    found = w.within(rows, {"transaction_id": ids})
    want = sorted(f"t{i}" for i in range(3, 600, 3))
    assert sorted(r["transaction_id"] for r in found.collect()) == want
    request = LookupRequest(sort_by="transaction_id", limit=1000, descending=False)
    assert [r["transaction_id"] for r in tools.lookup(rows, request, tables={"transaction_id": ids}).collect()] == want
    plan = plan_of(found)
    assert ("getbit" in plan) == (most == 0)
    if most:
        assert "BroadcastHashJoin" in plan and "hashpartitioning(transaction_id" not in plan
    else:
        first = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
        assert first.index("ShuffledHashJoin") < first.index("hashpartitioning(transaction_id") < first.index("getbit")  # the bitmap stands below the join and its shuffle


def test_several_tables_and_requests(spark, rows):
    accounts, merchants = spark.createDataFrame([(f"a{i}",) for i in range(5)], "id string"), spark.createDataFrame([("uber",)], "m string")
    by = SpendRequest(group_by="account", account_ids=("a1", "a2", "a30"))
    got = {r["key"] for r in tools.spend_grouped(rows, by, tables={"account_id": accounts, "merchant": merchants}).collect()}
    assert got == {"a1", "a2"}
    assert tools.spend_total(rows, SpendRequest(), tables={"account_id": accounts.where("false")}).first()["transaction_count"] == 0
    n = tools.spend_by_currency(rows, SpendRequest(), tables={"account_id": accounts}).agg(F.sum("transaction_count")).first()[0]
    assert n == rows.where("account_id in ('a0', 'a1', 'a2', 'a3', 'a4')").count()


def test_wrong_tables(spark, rows):
    with pytest.raises(LookupInputError):
        tools.lookup(rows, LookupRequest(), tables={"nothing": spark.createDataFrame([("x",)], "a string")})
    with pytest.raises(InputError):
        w.within(rows, {"account_id": spark.createDataFrame([("x", "y")], "a string, b string")})


def test_bitmaps_miss_nothing(spark):
    r = random.Random(3)
    ids = [f"{r.random()}" for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in ids], "id string")
    others = spark.createDataFrame([(f"no{i}",) for i in range(3000)], "id string")
    for bits in (1 << 16, 1 << 18):
        marks = w.bitmap(df, "id", bits)
        assert marks.count() <= bits // 32768 and marks.agg(F.max(F.length("bitmap"))).first()[0] == 4096
        assert w.may_be_among(df, "id", marks, bits).count() == 3000
        assert w.may_be_among(others, "id", marks, bits).count() < 300


def test_explanation_of_each_kind(rows):
    request = SpendRequest(group_by="category")
    x = explain.explanation(explain.ExplainRequest(" SPEND ", "my_focus", detail="low"), tools.spend_total(rows, request), tools.spend_grouped(rows, request)).first()
    assert x["source_type"] == "spend" and x["confidence"] == "medium" and len(x["warnings"]) == 1
    assert [b["title"] for b in x["blocks"]][0] == "Total spend" and x["blocks"][1]["title"].startswith("My Focus: ") and len(x["blocks"]) == 2
    assert x["summary_flags"]["multi_currency"] and x["summary_flags"]["warning_count"] == 1 and x["summary_flags"]["explanation_confidence"] == "medium"
    alone = explain.explanation(explain.ExplainRequest("spend"), tools.spend_total(rows, SpendRequest(direction="credit"))).first()
    assert len(alone["blocks"]) == 1 and alone["summary_flags"]["empty_result"] and not alone["summary_flags"]["has_groups"] and alone["confidence"] == "high"
    y = explain.explanation(explain.ExplainRequest("transactions", include_warnings=False, detail="high"), tools.lookup(rows, LookupRequest())).first()
    assert y["warnings"] == [] and y["summary_flags"]["warning_count"] == 1 and y["confidence"] == "medium" and len(y["blocks"]) == 6
    none = explain.explanation(explain.ExplainRequest("transactions"), tools.lookup(rows, LookupRequest(direction="credit"))).first()
    assert none["blocks"] == [] and none["summary_flags"]["empty_result"] and none["warnings"]


def test_explanation_of_recurring(rows):
    labelled = rows.withColumns({"is_recurring": F.lit(True), "recurrence_cadence": F.when(F.col("merchant") == "uber", "weekly").otherwise("irregular"), "recurrence_confidence": F.when(F.col("merchant") == "uber", "medium").otherwise("low")})
    x = explain.explanation(explain.ExplainRequest("recurring"), tools.recurring_streams(labelled, RecurringRequest(limit=500))).first()
    assert x["confidence"] == "medium" and set(x["summary_flags"]["count_by_cadence"]) == {"weekly", "irregular"}
    assert x["blocks"][0]["title"] == "Primary recurring payment" and x["summary_flags"]["record_count"] == sum(x["summary_flags"]["count_by_cadence"].values())
    none = explain.explanation(explain.ExplainRequest("recurring"), tools.recurring_streams(labelled, RecurringRequest(merchants=("nobody",)))).first()
    assert none["blocks"] == [] and none["confidence"] == "medium" and none["summary_flags"]["empty_result"]


@pytest.mark.parametrize("wrong", [{"kind": "other"}, {"kind": 1}, {"kind": "spend", "detail": "most"}, {"kind": "spend", "include_warnings": 1}, {"kind": "spend", "focus": 3}])
def test_wrong_requests(wrong):
    with pytest.raises(ExplainInputError):
        explain.ExplainRequest(**wrong)


def test_wrong_results(rows):
    with pytest.raises(ExplainInputError):
        explain.explanation(explain.ExplainRequest("recurring"), tools.lookup(rows, LookupRequest()))
    with pytest.raises(ExplainInputError):
        explain.explanation(explain.ExplainRequest("balance"), rows)
