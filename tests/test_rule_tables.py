"""Tables of rules against the chain of conditions, and what is wrong with rules."""

import os
import random

import pytest

from brasstally.errors import CategoryConfigError
from brasstally.operators import categories as c
from brasstally.operators import normalize
from brasstally.plans import canonical

DATA = "/root/testdata/sf0.001"
OUT = ("transaction_id", "merchant_mapped", "category_mapped", "subcategory_mapped", "category_mapping_source")


def sorted_rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*OUT).collect())


def payments(spark, r, n):
    words = ["Melcom", "melcom gh", " uber ", "bolt a.b", "salary", "ab", "abab", "", None, "shop 7", "ȷ é"]
    rows = [(str(i), None, 1.0, r.choice(["credit", "Debit ", None]), r.choice(words), r.choice(["transfer", "utility", "groceries", "x1", None])) for i in range(n)]
    return spark.createDataFrame(rows, "transaction_id string, timestamp timestamp, amount double, direction string, merchant_normalized string, category_normalized string").repartition(3)


def made_rules(r, n):
    values = ["melcom", " Uber", "b", "ab", "a.b", "transfer", "bills", "credit", "sal", "op 7", "é", "x", "", "b$", "^ab+", "[0-9]$"]
    made = []
    for i, priority in enumerate(r.sample(range(10 * n), n)):
        value = r.choice([v for v in values if v]) if i % 3 else f"name {i}"
        how = r.choice(c.HOW) if not value.startswith("name") else r.choice(("exact", "contains"))
        made.append(c.Rule(priority, r.choice(c.FIELDS), how, value, r.choice(("income", "fees", "other")), "general", r.choice([None, None, " UBER ", "ab"]), r.choice([None, None, "Credit"])))
    return tuple(sorted(made, key=lambda x: x.priority))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("most", [0, 10**6])
def test_same_as_the_chain(spark, monkeypatch, seed, most):
    monkeypatch.setattr(c, "MOST_VERDICTS", most)
    r = random.Random(seed)
    df, rules = payments(spark, r, 120), made_rules(r, 40)
    config = c.CategoryConfig(rules=rules)
    assert sorted_rows(c.map_by_rules(df, c.rules_table(spark, rules))) == sorted_rows(c.map_categories(df, config))


def test_ten_thousand_rules(spark):
    r = random.Random(9)
    df, few = payments(spark, r, 200), made_rules(r, 30)
    more = tuple(c.Rule(10**6 + i, c.FIELDS[i % 2], ("exact", "contains")[i // 2 % 2], f"nobody {i}", "fees", "general") for i in range(10_000))
    assert sorted_rows(c.map_by_rules(df, c.rules_table(spark, few + more))) == sorted_rows(c.map_categories(df, c.CategoryConfig(rules=few)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_default_rules(spark):
    raw = canonical.raw_transactions(spark, DATA)
    for df in (canonical.unnormalized_for_mapping(raw), canonical.for_mapping(normalize.transactions(raw))):
        assert sorted_rows(c.map_by_rules(df, c.rules_table(spark, c.CategoryConfig().rules))) == sorted_rows(c.map_categories(df))


def test_no_rules_and_no_rows(spark):
    df = payments(spark, random.Random(1), 20)
    none = c.rules_table(spark, [])
    out = c.map_by_rules(df, none)
    assert out.count() == 20 and {r["category_mapping_source"] for r in out.collect()} <= {"category_alias", "default_fallback"}
    assert c.map_by_rules(df.limit(0), c.rules_table(spark, c.CategoryConfig().rules)).count() == 0
    assert c.map_by_rules(df, none).columns == c.map_categories(df).columns


def test_wrong_rules_are_counted(spark):
    df = payments(spark, random.Random(1), 5)
    wrong = [c.Rule(1, "amount", "exact", "x", "fees", "general"), c.Rule(1, "direction", "like", " ", "fees", "general"), c.Rule(2, "direction", "exact", "x", "nothing", "other")]
    with pytest.raises(CategoryConfigError, match="1 rules of an unknown field.*1 rules of an unknown match.*1 rules without a value.*1 rules of a category.*1 rules of a subcategory.*1 rules that repeat"):
        c.map_by_rules(df, c.rules_table(spark, wrong))
    with pytest.raises(CategoryConfigError, match="lack"):
        c.map_by_rules(df, c.rules_table(spark, []).drop("how"))
