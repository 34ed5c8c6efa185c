"""Versioned tables, the stored processed transactions with their plans, and labels of popular groups."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from brasstally.errors import IngestError
from brasstally.operators import recurrence, tools
from brasstally.plans import canonical
from brasstally.plans.requests import LookupRequest, SpendRequest
from brasstally.sources.documents import read_store, write_store
from brasstally.sources.versions import exists, read_version, write_version

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return df._jdf.queryExecution().toString()


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(IngestError, match="holds no table"):
        read_version(spark, root)
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    write_store(rows, root)
    fails = rows.withColumn("embedding", F.when(F.col("vec_id") == 8, F.raise_error(F.lit("broken"))).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="broken"):
        write_store(fails, root)
    assert sorted(r["vec_id"] for r in read_store(spark, root).collect()) == list(range(9))
    held = read_store(spark, root)
    write_store(rows.where("vec_id < 3"), root)
    assert read_store(spark, root).count() == 3 and held.count() == 9  # a reader keeps the version it began with
    with pytest.raises(IngestError):
        write_store(rows.where("vec_id > 99"), root)
    assert read_store(spark, root).count() == 3


def test_versions_by_name_and_emptied_ones(spark, tmp_path):
    root = str(tmp_path / "t")
    assert not exists(spark, root)
    names = [write_version(spark.createDataFrame([(i, f"0{i}")], "a int, part string"), root, ("part",), keep=2) for i in range(3)]
    assert [(r.a, r.part) for r in read_version(spark, root).collect()] == [(2, "02")]  # leading zeros stay
    assert read_version(spark, root, names[1]).first().a == 1 and read_version(spark, root, names[0]).count() == 0
    with pytest.raises(IngestError, match="no version"):
        read_version(spark, root, "other")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("processed"))
    base = dt.datetime(2026, 1, 31, 22)
    rows = [(str(i), f"{i % 50:03}", base + dt.timedelta(hours=3 * i), -1.0 * i, "GHS", ("credit", "debit")[i % 2], "m", "food", "x") for i in range(1500)] + [("none", "001", None, -5.0, "GHS", "debit", "m", "food", "x")]
    df = spark.createDataFrame(rows, "transaction_id string, account_id string, timestamp timestamp, amount double, currency string, direction string, merchant string, category string, subcategory string")
    canonical.write_processed(df, root)
    return df, canonical.read_processed(spark, root)


@pytest.mark.parametrize("start,end", [("2026-02-01", "2026-02-28T23:59:59"), ("2026-01-31T23:00:00", None), (None, "2026-03-01"), ("2026-02-01T00:30:00+02:00", "2026-02-01T01:00:00+02:00"), (None, None)])
def test_stored_results_are_those_of_the_rows(stored, start, end):
    df, store = stored
    for request in (LookupRequest(start=start, end=end, account_ids=("003", "004"), limit=2000), LookupRequest(start=start, end=end, sort_by="amount", limit=7)):
        assert tools.lookup(store, request).collect() == tools.lookup(df, request).collect()
    request = SpendRequest(start=start, end=end, group_by="category")
    assert tools.spend_total(store, request).collect() == tools.spend_total(df, request).collect()
    assert tools.spend_grouped(store, request).collect() == tools.spend_grouped(df, request).collect()


def test_ranges_prune_months_and_filters_reach_the_files(stored):
    _, store = stored
    plan = plan_of(tools.spend_total(store, SpendRequest(start="2026-02-01", end="2026-02-28", account_ids=("003",))))
    scan = plan[plan.index("== Physical Plan ==") :]
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", scan)[1]
    assert "month" in filters and "2026-02" in filters
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", scan)[1]
    assert "EqualTo(direction,debit)" in pushed and "account_id" in pushed and "timestamp" in pushed
    assert "subcategory" not in re.search(r"ReadSchema: struct<(.*?)>", scan)[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_store_is_written_once(spark):
    first, again = (canonical.processed_store(spark, DATA) for _ in range(2))
    assert first.inputFiles() == again.inputFiles() and first.count() == canonical.processed(canonical.raw_transactions(spark, DATA)).count()


def labels_by_loop(rows):
    """(gaps, sum of gaps, least, most) of one group, neighbour by neighbour."""
    at = sorted(t for _, t, _ in rows if t is not None)
    return [(b - a) // dt.timedelta(days=1) for a, b in zip(at, at[1:], strict=False)]


def test_popular_day_of_one_group(spark):
    r = random.Random(2)
    day = dt.datetime(2026, 5, 4)
    hot = [(i, day + dt.timedelta(microseconds=r.randrange(86_400_000_000)), -1.0) for i in range(5000)]
    rows = hot + [(5000 + k, day + dt.timedelta(days=7 * k, hours=r.randrange(24)), -1.0) for k in range(1, 6)] + [(6000, dt.datetime(1969, 12, 31, 23), -1.0), (6001, dt.datetime(1970, 1, 1, 1), -1.0), (6002, None, -1.0)]
    df = spark.createDataFrame([(str(o), t, a, "debit", "m", "c", "s", o) for o, t, a in rows], "transaction_id string, timestamp timestamp, amount double, direction string, merchant_mapped string, category_mapped string, subcategory_mapped string, _ord long").repartition(8)
    out = recurrence.label(df)
    got = out.select("recurrence_occurrence_count", "recurrence_interval_days", "recurrence_cadence").distinct().collect()
    gaps = labels_by_loop(rows)
    assert len(got) == 1 and got[0][0] == len(rows) and abs(got[0][1] - sum(gaps) / len(gaps)) < 1e-12
    plan = plan_of(out)
    plan = plan[plan.index("== Physical Plan ==") :]
    # rows meet only as aggregates that tasks have combined before; the one window is over days
    assert plan.count("Window [lag(_to") == 1 and plan.count("Window [") == 1 and "partial_count" in plan


@pytest.mark.parametrize("seed", range(3))
def test_labels_against_a_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(days=r.choice([0, 7, 14, 21, 30, 60]), hours=r.choice([0, 0, 12, 23]), microseconds=r.choice([0, 5])), r.choice("ab")) for i in range(r.randint(1, 12))]
    df = spark.createDataFrame([(str(o), t, -2.0, "debit", m, "c", "s", o) for o, t, m in rows], "transaction_id string, timestamp timestamp, amount double, direction string, merchant_mapped string, category_mapped string, subcategory_mapped string, _ord long").repartition(3)
    got = {x[0]: (x[1], x[2]) for x in recurrence.label(df).select("merchant_mapped", "recurrence_occurrence_count", "recurrence_interval_days").distinct().collect()}
    for m in {x[2] for x in rows}:
        gaps = labels_by_loop([x for x in rows if x[2] == m])
        assert got[m][0] == len(gaps) + 1 and abs(got[m][1] - (sum(gaps) / len(gaps) if gaps else 0)) < 1e-12
