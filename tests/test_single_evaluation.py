"""Texts are cleaned once for each row, and a lookup runs once for all blocks that explain it."""

import os

import pytest

from brasstally import queries
from brasstally.plans import canonical

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_texts_are_cleaned_once(spark):
    plan = canonical.mapped(canonical.raw_transactions(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    # six columns in two steps, marks, the cleaned merchant in two steps, and three compared forms
    assert plan.count("regexp_replace(") <= 18


@pytest.mark.parametrize("name", ["explain_transactions", "explain_recurring"])
def test_lookups_run_once(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert " parquet" not in plan and "Relation [" not in plan
