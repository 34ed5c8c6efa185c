import datetime as dt

import pytest
from pyspark.sql import functions as F

from brasstally.errors import CategoryConfigError, CategoryInputError, NormalizeError, QualityInputError, RecurrenceConfigError, RecurrenceInputError
from brasstally.operators import categories, normalize, quality, recurrence

TX = "transaction_id string, account_id string, amount double, currency string, timestamp timestamp, merchant string, category string, description string"


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_normalize(spark):
    rows = [(" t1 ", "a1", -5.0, "cedi", ts("2026-03-05T10:00:00"), "melcom gh", "Grocery", " x  y "), (None, None, float("nan"), None, None, None, None, None)]
    got = normalize.transactions(spark.createDataFrame(rows, TX)).collect()
    assert (got[0].transaction_id, got[0].currency, got[0].merchant_clean, got[0].category, got[0].description) == ("t1", "GHS", "Melcom Gh", "groceries", "x y")
    assert (got[0].date, got[0].month, got[0].direction) == ("2026-03-05", "2026-03", "debit")
    assert got[1].amount is None and got[1].direction is None and got[1].date is None
    config = normalize.NormalizeConfig(drop_invalid_rows=True)
    assert normalize.transactions(spark.createDataFrame(rows, TX), config).count() == 1
    assert normalize.transactions(spark.createDataFrame([], TX)).count() == 0
    with pytest.raises(NormalizeError):
        normalize.transactions(spark.createDataFrame(rows, TX).drop("amount"))


def test_bundle(spark):
    tables = {"accounts": spark.createDataFrame([("a1", " Main ", "Checking", "usd")], "account_id string, account_name string, account_type string, currency string"), "other": spark.range(2)}
    got = normalize.bundle(tables)
    assert got["accounts"].first().account_type == "current" and got["other"].count() == 2


MAP = "transaction_id string, timestamp timestamp, amount double, direction string, merchant_normalized string, category_normalized string"


def mapped(spark, rows, config=None):
    df = spark.createDataFrame([(str(i), None, 1.0, d, m, c) for i, (d, m, c) in enumerate(rows)], MAP)
    return [(r.category_mapped, r.subcategory_mapped, r.category_mapping_source) for r in categories.map_categories(df, config).orderBy("transaction_id").collect()]


def test_all_rules(spark):
    rows = [("credit", "salary", "x"), (None, "", "transfer"), (None, "Melcom GH", None), (None, "shell", ""), (None, "uber bv", ""), (None, "", "utilities"), (None, "", "bank_fee"), (None, "", "atm_withdrawal"), (None, "", "Taxi"), (None, None, None)]
    got = mapped(spark, rows)
    assert [g[2] for g in got] == [f"rule:{p}" for p in range(10, 90, 10)] + ["category_alias", "default_fallback"]
    assert got[8] == ("transport", "general", "category_alias") and got[9] == ("other", "uncategorized", "default_fallback")
    assert mapped(spark, []) == []


def test_rules_of_a_config(spark):
    rule = categories.Rule(1, "merchant_normalized", "regex", r"\Sbar$", "fees", "general")
    second = categories.Rule(2, "category_normalized", "contains", "ood", "cash", "general", direction="debit")
    config = categories.CategoryConfig(rules=(second, rule))
    assert [g[2] for g in mapped(spark, [("debit", "foobar", "food"), ("credit", "foobar", "food"), ("credit", "bar", "food")], config)] == ["rule:2", "rule:1", "default_fallback"]
    for bad in (dict(rules=(rule, rule)), dict(default=("nowhere", "general")), dict(categories=()), dict(rules=(categories.Rule(1, "amount", "exact", "x", "fees", "general"),)), dict(rules=(categories.Rule(1, "direction", "exact", " ", "fees", "general"),))):
        with pytest.raises(CategoryConfigError):
            categories.CategoryConfig(**bad).checked()
    with pytest.raises(CategoryInputError):
        categories.map_categories(spark.range(1))


REC = "transaction_id string, timestamp timestamp, amount double, direction string, merchant_mapped string, category_mapped string, subcategory_mapped string, _ord long"


def labelled(spark, days, amounts, config=None):
    start = ts("2026-01-01T12:00:00")
    rows = [(str(i), start + dt.timedelta(days=d), a, "debit", "m", "c", "s", i) for i, (d, a) in enumerate(zip(days, amounts, strict=True))]
    return recurrence.label(spark.createDataFrame(rows, REC), config).first()


@pytest.mark.parametrize(
    ("days", "cadence", "confidence", "recurring"),
    [
        ([0, 7, 14, 21], "weekly", "high", True), ([0, 7, 14], "weekly", "medium", True), ([0, 14, 28, 42], "biweekly", "high", True), ([0, 30, 61, 91], "monthly", "high", True),
        ([0, 1, 5, 8], "irregular", "medium", True), ([0, 1, 40], "none", "low", False), ([0], "none", "low", False), ([0, 100], "irregular", "low", False), ([0, 5, 14, 21], "weekly", "medium", True),
    ],
)
def test_cadence(spark, days, cadence, confidence, recurring):
    got = labelled(spark, days, [10.0] * len(days))
    assert (got.recurrence_cadence, got.recurrence_confidence, got.is_recurring, got.recurrence_occurrence_count) == (cadence, confidence, recurring, len(days))


def test_amounts(spark):
    days = [0, 7, 14, 21]
    assert labelled(spark, days, [100.0, 104.0, 100.0, 100.0]).is_recurring
    assert not labelled(spark, days, [100.0, 110.0, 100.0, 100.0]).is_recurring
    assert not labelled(spark, days, [0.0, 6.0, 0.0, 0.0]).is_recurring
    assert labelled(spark, days, [-100.0, -500.0, -100.0, -100.0]).is_recurring
    assert not labelled(spark, days, [-100.0, -500.0, -100.0, -100.0], recurrence.RecurrenceConfig(absolute_reference=True)).is_recurring
    got = labelled(spark, [21, 14, 7, 0], [50.0, 51.0, 50.0, 50.0])
    assert got.recurrence_amount_reference == 50.0 and got.recurrence_interval_days == 7.0


def test_gaps_are_elapsed_days(spark):
    rows = [("0", ts("2026-01-01T23:00:00"), 1.0, "debit", "m", "c", "s", 0), ("1", ts("2026-01-02T01:00:00"), 1.0, "debit", "m", "c", "s", 1)]
    assert recurrence.label(spark.createDataFrame(rows, REC)).first().recurrence_interval_days == 0.0


def test_recurrence_errors(spark):
    with pytest.raises(RecurrenceConfigError):
        recurrence.RecurrenceConfig(min_group=1).checked()
    with pytest.raises(RecurrenceInputError):
        recurrence.label(spark.range(1))
    with pytest.raises(RecurrenceInputError):
        recurrence.label(spark.createDataFrame([("0", None, 1.0, "debit", "m", "c", "s", 0)], REC), strict=True)
    assert recurrence.label(spark.createDataFrame([], REC)).count() == 0


def quality_frame(spark, rows):
    schema = "transaction_id string, timestamp timestamp, amount double, direction string, merchant_mapped string, category_mapped string, subcategory_mapped string, category_mapping_source string, is_recurring boolean, recurrence_cadence string, recurrence_confidence string, recurrence_group_key string, recurrence_occurrence_count long, _ord long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


GOOD = ("t1", ts("2026-01-01T00:00:00"), 5.0, "debit", "m", "cash", "general", "rule:1", True, "weekly", "high", "k", 6)


def change(**values):
    names = ("transaction_id", "timestamp", "amount", "direction", "merchant_mapped", "category_mapped", "subcategory_mapped", "category_mapping_source", "is_recurring", "recurrence_cadence", "recurrence_confidence", "recurrence_group_key", "recurrence_occurrence_count")
    return tuple(values.get(n, v) for n, v in zip(names, GOOD, strict=True))


def test_quality(spark):
    clean = quality.report(quality.findings(quality_frame(spark, [GOOD]), "2026-06-01"))
    assert quality.report_to_dict(clean) == {"passed": True, "errors": 0, "warnings": 0, "findings": []}
    rows = [
        GOOD, GOOD, change(transaction_id=None), change(transaction_id=None, amount=float("nan")), change(transaction_id="d", direction=None), change(transaction_id="e", category_mapped="food"), change(transaction_id="f", timestamp=ts("1999-01-01T00:00:00")),
        change(transaction_id="g", timestamp=ts("2026-07-01T00:00:00")), change(transaction_id="h", amount=-1.0), change(transaction_id="i", recurrence_group_key=" "), change(transaction_id="j", recurrence_occurrence_count=3), change(transaction_id="k", is_recurring=False),
    ]
    got = {r.check_name: (r.row_count, r.sample_ids) for r in quality.findings(quality_frame(spark, rows), "2026-06-01").collect()}
    assert got["duplicate_transaction_id"] == (4, ["t1", "t1", "null", "null"])
    assert got["null_transaction_id"][0] == 2 and got["null_direction"] == got["enum_direction"] == (1, ["d"])
    assert got["enum_category_mapped"] == (1, ["e"]) and got["timestamp_too_early"] == (1, ["f"]) and got["timestamp_future"] == (1, ["g"])
    assert got["amount_not_positive"] == (1, ["h"]) and got["amount_not_numeric"][0] == 1 and got["recurring_without_group"] == (1, ["i"])
    assert got["recurring_too_few"] == (1, ["j"]) and got["not_recurring_but_labelled"] == (1, ["k"])
    less = quality.QualityConfig(min_occurrences=3, allow_future=True, samples=1)
    names = {r.check_name: r.sample_ids for r in quality.findings(quality_frame(spark, rows), "2026-06-01", less).collect()}
    assert "recurring_too_few" not in names and "timestamp_future" not in names and names["duplicate_transaction_id"] == ["t1"]
    with pytest.raises(QualityInputError):
        quality.findings(spark.range(1), "2026-06-01")


def test_coverage(spark):
    df = spark.createDataFrame([("rule:10",), ("rule:10",), (None,), ("category_alias",), ("default_fallback",)], "category_mapping_source string")
    got = {r.measure: r.n for r in categories.mapping_coverage(df).collect()}
    assert got == {"total": 5, "by_rule": 2, "source:rule:10": 2, "source:missing": 1, "category_alias": 1, "source:category_alias": 1, "default_fallback": 1, "source:default_fallback": 1}


def test_plans_have_no_python(spark):
    df = recurrence.label(spark.createDataFrame([("0", None, 1.0, "debit", "m", "c", "s", 0)], REC).repartition(2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    assert F.lit(1) is not None
