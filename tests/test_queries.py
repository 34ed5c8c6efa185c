"""Registered queries against their SQL on the smallest tables, and the streaming operators."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from brasstally import queries as analytics
from brasstally.streaming import spend

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(analytics.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = analytics.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = duck.execute(analytics.ORACLE_SQL[name])
    at = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(at) == columns
    theirs = sorted(repr(tuple(plain(r[at[c]]) for c in columns)) for r in result.fetchall())
    assert ours == theirs


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert set(analytics.QUERIES) - set(analytics.ORACLE_SQL) == {"store_projection", "corpus_tokens"}
    assert analytics.QUERIES["store_projection"](spark, DATA).count() > 0


def test_streams(spark, tmp_path):
    rows = [("a", dt.datetime(2026, 1, 1, 5), -1.5, "cash", "USD"), ("a", dt.datetime(2026, 1, 1, 6), -1.5, "cash", "USD"), ("b", dt.datetime(2026, 1, 1, 7), -2.0, "cash", "USD"), ("c", dt.datetime(2026, 1, 9), -3.0, "cash", "USD")]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp, amount double, category string, currency string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("totals", spend.spend_by_window(stream), "update"), ("firsts", spend.first_of_each(stream), "append")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    totals = {r.start.day: (str(r.total_amount), r.transaction_count) for r in spark.table("totals").collect()}
    assert totals[1] == ("-5.00", 3) and totals[9] == ("-3.00", 1)
    assert spark.table("firsts").count() == 3
